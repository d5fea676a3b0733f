"""Operators on documents against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, langid, merkle, packing, secret_scan, simhash, suffix_dedup, vocab
from pulsegrid.llm.components import components
from tests.llm.conftest import words


def keyed(rows):
    return Counter(tuple(r) for r in rows)


# --- 2: repeated byte strings


def repeats(rows, window):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(b[k : k + window] for b in texts for k in range(len(b) - window + 1))
    out = []
    for (doc_id, *_), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), spans, kept))
    return keyed(out)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_repeats(make_docs, odd_rows, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 1: every core goes by single windows
    found = suffix_dedup.remove_repeats(make_docs(odd_rows)).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found) == repeats(odd_rows, 400)


def test_repeats_with_edits_and_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 777)
    rng = random.Random(8)
    base = words(rng, 400)
    rows = [(k, base[rng.randint(0, 500) : rng.randint(900, 2000)] + rng.choice("xyz") + base[rng.randint(0, 900) :], "en") for k in range(25)]
    found = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found) == repeats(rows, 400)


def without_repeated_words(text, shared, count=50):
    """Plain loop: the text less every word of a ``count``-word string in ``shared``, each with the white space behind it."""
    found = list(re.finditer(rb"[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*", text))
    own, gone = text.split(), set()
    for k in range(len(own) - count + 1):
        if shared[tuple(own[k : k + count])] > 1:
            gone.update(range(k, k + count))
    lead = text[: found[0].start()] if found else text
    return lead + b"".join(m.group() for k, m in enumerate(found) if k not in gone)


def repeated_words(texts, count=50):
    raws = [(t or "").encode() for t in texts]
    shared = Counter(tuple(own[k : k + count]) for own in (r.split() for r in raws) for k in range(len(own) - count + 1))
    return [without_repeated_words(r, shared, count).decode() for r in raws]


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_repeated_words(make_docs, odd_rows, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    rng = random.Random(18)
    passages = {n: words(rng, n) for n in (49, 50, 51, 62, 200)}
    rows = odd_rows + [(100 * n + k, f"  {words(rng, 30)}\n\n{p}\u00a0\t {words(rng, 20)} ", "en") for n, p in passages.items() for k in range(4)]
    rows += [(9_000 + k, f"{words(rng, 10)} {p} {words(rng, 10)}", "en") for k, p in enumerate(passages.values())]
    found = suffix_dedup.remove_repeats(make_docs(rows), suffix_dedup.WORDS, as_text=True).collect()
    want = Counter(zip((r[0] for r in rows), repeated_words([r[1] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.kept) for r in found) == want
    assert any(r.n_removed and r.doc_id == 5_100 for r in found) and not any(r.n_removed for r in found if r.doc_id == 4_900)


def test_workers_let_go_of_a_vocabulary(make_docs):
    """A worker that has packed holds up to a million words; its first task of the next step drops them."""
    rows = suffix_dedup.rows_of(make_docs([(1, "a", "en")]))
    held = SimpleNamespace(schema=rows.schema, mapInArrow=lambda work, schema: work)
    vocab.word_encoder(public_tokenizers.path(packing.VOCABULARY)).encode(pa.array(["some words"]))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "mark": [2], "text": ["x y " * 40]})
    (found,) = suffix_dedup.parsed(held, suffix_dedup.WORDS, False)(iter([batch]))
    assert found.num_rows and vocab.word_encoder.cache_info().currsize == 0


def test_repeats_of_nothing(make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


# --- 3: SimHash


def brute_simhash(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    parts = [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates(make_docs, odd_rows):
    rng = random.Random(3)
    long = words(rng, 4000)
    rows = [*odd_rows, *((100 + k, long.replace(" ", " QQ ", k).upper(), "en") for k in range(4))]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    fps = {t: brute_simhash(t) for _, t, _ in rows}
    groups = brute_groups(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t, _ in rows:
        g = groups[fps[t]]
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert keyed(got) == Counter((i, f"{fps[t]:016x}", least[groups[fps[t]]]) for i, t, _ in rows)
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_tree_search_is_exact(corpus_spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    noisy = centres[rng.integers(0, 300, 3000)]
    for _ in range(3):
        noisy = noisy ^ (np.uint64(1) << rng.integers(0, 64, len(noisy)).astype(np.uint64))
    fps = np.unique(np.concatenate([noisy, rng.integers(0, 1 << 64, 2000, dtype=np.uint64)]))
    ids = np.arange(len(fps))
    table = corpus_spark.createDataFrame([(int(f), int(i)) for f, i in zip(fps.view(np.int64), ids, strict=True)], "fp long, rep long")
    got = {r.id: r.component_id for r in components(simhash.near_links(table, shard=64)).collect()}
    forest = simhash.Forest(len(fps))
    for k in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 3)
        forest.join(np.full(len(near), k), near)
    assert [got.get(i, i) for i in ids.tolist()] == forest.root.tolist()


def test_components_of_a_path_and_a_star(corpus_spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 900 + k) for k in range(50)] + [(5, 5), (None, 3), (3, 950), (950, 3)]
    got = {r.id: r.component_id for r in components(corpus_spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, **{900 + k: 7 for k in range(50)}, 3: 3, 950: 3}
    assert components(corpus_spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4: Merkle fingerprints


def test_edited_fingerprints(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6] + [(6, odd_rows[5][1], "en")]
    got = {(r.doc_id, r.n_chars): r for r in merkle.edited_fingerprints(make_docs(rows)).collect()}
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    texts = [t or "" for _, t, _ in ordered]
    by_text = {}
    for k, (doc_id, *_) in enumerate(ordered[:-1]):
        own, following = texts[k], texts[k + 1]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = got[doc_id, len(own)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(own, r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    assert sum(r.near_edited for r in got.values()) > 0.3 * len(got)
    assert merkle.edited_fingerprints(make_docs([])).count() == 0
    (only,) = merkle.edited_fingerprints(make_docs([(1, "abcd", "en")])).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_next_over_many_ranges(corpus_spark):
    ids = [3, 9, 9, 14, 15, 200, 201, 5000]
    rows = corpus_spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    ranged = merkle.ranges(rows, "doc_id", F.xxhash64("text"), buckets=5)
    got = {r.text: r.next_doc_id for r in merkle.with_next(ranged, "doc_id", ["doc_id"]).collect()}
    assert sorted(got.values()) == sorted(ids) and got["t7"] == 201 and got["t0"] == 5000 and got["t3"] == 9


def test_changed_paragraphs(corpus_spark):
    old = "\n".join(f"line {k}" for k in range(40))
    new = old.replace("line 3\n", "line three\n").replace("line 35", "row 35")
    rows = corpus_spark.createDataFrame([(old, new), (old, old), ("", None)], "a string, b string")
    trees = merkle.with_tree(merkle.with_tree(rows, "a", "ta"), "b", "tb")
    assert [r[0] for r in trees.select(merkle.changed_paragraphs("ta", "tb")).collect()] == [[3, 35], [], []]


# --- 5: secrets


def test_secret_scan(make_docs):
    rng = random.Random(6)
    rows, truth = [], set()
    for k in range(300):
        text = words(rng, 40)
        if k % 3 == 0:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            text += f' token = "{key}" ' + words(rng, 5)
            truth.add((k, text.index(key), key))
        elif k % 3 == 1:
            text += f" mail user{k}@mail.example.com tel +49 555 {k}1234567 see https://host.example.org/a{k}/b/c.html " + words(rng, 9)
        rows.append((k, text, "en"))
    rows += [(1000, None, None), (1001, "", "en"), (None, "nothing here", "en")]
    docs = make_docs(rows)
    got = {(r.doc_id, r.start, r.secret) for r in secret_scan.scan(docs).collect()}
    assert truth == got
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    shown = {r.doc_id: r.text for r in clean.collect()}
    assert all(key not in shown[i] and "[secret]" in shown[i] for i, _, key in truth) and shown[1] == rows[1][1] and shown[1000] is None
    assert secret_scan.scan(make_docs([])).count() == 0
    private = "-----BEGIN RSA PRIVATE KEY-----\nMIIBOgIBAAJBAK\n-----END RSA PRIVATE KEY-----"
    (one,) = secret_scan.candidates(make_docs([(1, "see " + private, "en")])).collect()
    assert (one.start, one.candidate) == (4, private)


def test_labelled_findings_decide(make_docs):
    docs = make_docs([(k, f"order no. {k}AB{k * 7919 % 10**8:08d} was sent, build x{k * 104729 % 10**9:09d}y done", "en") for k in range(100)])
    labelled = secret_scan.candidates(docs).withColumn("label", F.col("candidate").startswith("x").cast("double"))
    got = secret_scan.scan(docs, labelled=labelled).collect()
    assert len(got) == 100 and all(r.secret.startswith("x") for r in got)


# --- 7: packing


def test_packing(make_docs, odd_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokenizer.encode_special_tokens = True
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 6] + [(6, odd_rows[5][1], "en")]
    got = packing.pack_documents(make_docs(rows)).toPandas()
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == doc_id].sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    packs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (packs.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert packs.length.sum().max() <= packing.LENGTH
    assert packing.pack_documents(make_docs([])).count() == 0
    assert len(packing.pack_documents(make_docs(odd_rows)).toPandas()) > len(got)


def test_shortest_pack_first():
    rng = random.Random(1)
    for size in (8, 64, 2048):
        for _ in range(30):
            histogram = Counter(rng.randint(1, size) for _ in range(rng.randint(0, 400)))
            patterns = packing.shortest_pack_first(dict(histogram), size)
            assert all(sum(lengths) <= size and count > 0 for count, lengths in patterns)
            placed = Counter()
            for count, lengths in patterns:
                placed.update({n: count * k for n, k in Counter(lengths).items()})
            assert placed == histogram
    (pattern,) = packing.shortest_pack_first({4: 1_000_000_000}, 8)
    assert pattern == (500_000_000, [4, 4])


# --- 8: byte-level BPE


def test_byte_bpe(make_docs, odd_rows):
    path = public_tokenizers.path(bpe.VOCABULARY)
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.read_ranks(path), special_tokens={})
    got = keyed(bpe.digests(make_docs(odd_rows)).collect())
    want = Counter()
    for doc_id, text, _ in odd_rows:
        ids = reference.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(make_docs([])).count() == 0


def test_random_parts_as_tiktoken():
    path = public_tokenizers.path(bpe.VOCABULARY)
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.read_ranks(path), special_tokens={})
    encoder, rng = vocab.byte_encoder(path, public_tokenizers.PATTERN), random.Random(2)
    alphabet = ["a", "b", " ", "\n", "é", "1", "'s", "  ", "\t", "the", "漢", "🙂", "\u0301", "!", "-", "\x1c", "\x85", "\xa0", "."]
    texts = ["".join(rng.choice(alphabet) * rng.randint(1, rng.choice([1, 3, 30])) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    ids, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert all(ids[e - c : e].tolist() == reference.encode_ordinary(t) for t, e, c in zip(texts, ends, counts, strict=True))
    words_encoder = vocab.word_encoder(public_tokenizers.path(packing.VOCABULARY))
    texts = [t + rng.choice(["İ", "Σ!", "ﬁ.", ""]) for t in texts[:1500]]
    ids, counts = words_encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert all(ids[e - c : e].tolist() == words_encoder.tokenizer.encode(t, add_special_tokens=False).ids for t, e, c in zip(texts, ends, counts, strict=True))


def test_offsets_and_split_characters(make_docs):
    text = "naïve 🙂🙂 漢字, x"
    (row,) = bpe.encode(make_docs([(1, text, "en")]), offsets=True).collect()
    assert row.starts[0] == 0 and row.ends[-1] == len(text) and all(a < b for a, b in zip(row.starts, row.ends, strict=True))
    table = vocab.token_bytes(public_tokenizers.path(bpe.VOCABULARY))
    assert all(table[i].decode("utf-8", "ignore") in text[a:b] for i, a, b in zip(row.ids, row.starts, row.ends, strict=True))
    cut = next(k for k, i in enumerate(row.ids) if len(table[i].decode("utf-8", "ignore").encode()) < len(table[i]))
    spark = make_docs([]).sparkSession
    parts = spark.createDataFrame([(1, row.ids), (2, row.ids[: cut + 1]), (3, []), (None, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in bpe.decode(parts).collect()}
    assert got[1].text == text and got[2].text.endswith("\ufffd") and bytes(got[3].bytes) == b"" == bytes(got[None].bytes)


# --- 9: language


def test_language(make_docs, odd_rows):
    rng = random.Random(5)
    stems = {"aa": "ba da ga ka".split(), "bb": "ol em ir us".split(), "cc": "ñu ßo çe žy".split()}
    rows = [(k, " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(rng.randint(3, 60))), lang) for k in range(600) for lang in [rng.choice(list(stems))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (None, "badaga kada", "aa"), (1003, "olemir us", None), (5, "badaga", "aa")]
    got = langid.identify(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id != 5}
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    right = [by_id[i].lang_pred == lang for i, _, lang in rows[:600] if i != 5 and by_id[i].held_out]
    assert sum(right) > 0.97 * len(right) and by_id[1003].lang_pred == "bb"
    assert langid.identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "abc", None), (2, None, None)])).collect()} == {"und"}
