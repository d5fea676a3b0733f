"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from pulsegrid.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string, pos long, x1 string, total string"


def conversations_of(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    return own


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(own):
    nodes = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += children[key] == 0
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1]) if key else 0
    rows = []
    for key, members in nodes.items():
        ends = sorted(c for c in members if len(own[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        rows.append((min(members), len(key), parent, len(members), children[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def taken(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_over_the_table(corpus_spark):
    rows = [tuple(r) for r in corpus_spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(corpus_spark, SF)
    assert dict(got.dtypes)["n_leaves"] == "bigint" and dict(got.dtypes)["depth"] == "bigint"
    assert taken(got) == brute(rebuilt(conversations_of(rows)))


def odd(rng):
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "yes", "", None, "é😀"])) for c in range(-120, 420, 7) for t in range(rng.randint(1, 9))]
    rows += [(300, t, "user", "same") for t in range(4)] + [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(c, None if t == 0 else t, "user", f"turn {t}") for c in range(500, 540) for t in range(3)]  # copies of one conversation
    rows += [(600, t, "user", f"long {t}") for t in range(70)] + [(601 + k, t, "user", f"long {t}") for k in range(6) for t in range(10 * k + 7)]  # prefixes of one
    return rows + [(700, 5, "user", "again"), (700, 5, "user", "again"), (701, 1, None, None), (702, 1, "", "")]


@pytest.mark.parametrize("again", [False, True])
@pytest.mark.parametrize("chunk", [prefix_trie.CHUNK, 4])
def test_odd_conversations(corpus_spark, monkeypatch, again, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "RUN_TEXT", 60)
    rows = odd(random.Random(3))
    seen = set()
    rows = [r for r in rows if r[0] == 700 or (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]
    own = conversations_of(rows)
    got = prefix_trie.prefix_trie(corpus_spark.createDataFrame([(*r, None, None, "x") for r in rows], TURNS), rebuilt=again)
    assert taken(got) == brute(rebuilt(own) if again else own)


def test_turns_of_one_number_have_an_order(corpus_spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "b"), (2, 1, "user", "b"), (2, 1, "user", "a")]
    for given in (rows, rows[::-1]):
        got = taken(prefix_trie.prefix_trie(corpus_spark.createDataFrame([(*r, None, None, None) for r in given], TURNS)))
        assert [(r[0], r[1], r[3], r[6]) for r in got] == [(1, 0, 2, 2), (1, 1, 2, 2), (1, 2, 2, 1)]


def test_empty_table(corpus_spark):
    assert prefix_trie.prefix_trie(corpus_spark.createDataFrame([], TURNS), rebuilt=True).count() == 0
