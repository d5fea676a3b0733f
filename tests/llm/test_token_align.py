"""Cross-tokenizer alignment against plain encoding of every row."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pulsegrid.llm import queries, token_align
from pulsegrid.llm.vocab import byte_table

SF = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """(doc_id, measures) of each row, token by token."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    value = {c: k for k, c in enumerate(byte_table())}

    def tokens(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
        own_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
            return None
        links, groups, i, j, end_a, end_b, from_a, from_b = [], [], 0, 0, len(own_a[0]), len(own_b[0]), 0, 0
        while True:
            links.append((ids_a[i], ids_b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(",".join(map(str, ids_a[from_a : i + 1])) + "|" + ",".join(map(str, ids_b[from_b : j + 1])))
                from_a, from_b = i + 1, j + 1
            i, j = i + step_a, j + step_b
            if i == len(ids_a):
                break
            if step_a:
                end_a += len(own_a[i])
            if step_b:
                end_b += len(own_b[j])
        return len(ids_a), len(ids_b), groups, links

    found = [tokens(t) for _, t in rows]
    counts = Counter(pair for f in found if f for pair in set(f[3]))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = f
            best = sum(counts[p] == most[p[0]] for p in links)
            out.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def taken(df):
    return sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in df.collect()), key=str)


ODD = [
    "a  b", " a", "a ", "\n", " ", "a\nb c", "x▁y z", "<s> <0x41> <|endoftext|>", "don't we're '", "é é \U0001f600 \U0001f468‍\U0001f469", "a　b c d",
    "tab\tand\r\nline", "1234 5678.90", "\x00 null", "b" * 3000, "word " * 500, "... !!! ?", "ภาษา 中文 日本",
]


def test_query_over_the_documents(corpus_spark):
    rows = [(r.doc_id, r.text) for r in corpus_spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert taken(queries.op12_token_alignment(corpus_spark, SF)) == brute(rows)


@pytest.mark.parametrize("most", [token_align.MAX_PARTS, 3])
def test_odd_texts_copies_and_null_ids(corpus_spark, make_docs, odd_rows, monkeypatch, most):
    monkeypatch.setattr(token_align, "MAX_PARTS", most)
    rows = [*odd_rows, *[(100 + k, t, "en") for k, t in enumerate(ODD)], *[(200 + k, ODD[4], "en") for k in range(30)], (None, ODD[5], None), (1, ODD[5], None)]
    got = token_align.align(make_docs(rows), groups=True)
    assert taken(got) == brute([(i, t) for i, t, _ in rows])
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") == r.groups_sha256 for r in got.collect())


def test_pairs_of_the_corpus(corpus_spark, make_docs):
    docs = make_docs([(1, "tokens meet", "en"), (2, "tokens meet", "en"), (3, "tokens part", "en"), (4, None, "en")])
    rows = token_align.pair_table(docs).collect()
    assert {r.n for r in rows} <= {1, 2, 3} and any(r.n == 3 for r in rows) and all(r.best for r in rows if r.n == 3)
    assert token_align.pair_table(docs.limit(0)).count() == 0


def test_empty_table(corpus_spark, make_docs):
    assert token_align.align(make_docs([]).limit(0)).count() == 0
    assert taken(token_align.align(make_docs([(1, None, None), (None, "", "en")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
