"""Graph search against a comparison with every vector."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.llm import graph_search, queries
from pulsegrid.llm.common import table

ROWS = "vec_id long, embedding array<double>, label int, raw string, shard int, query string"


def brute(rows, k, every=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            other = [(-float(np.dot(w, v)), j) for j, w in good if j != i and len(w) == len(v)]
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(other)[:k]])
    return out


def taken(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_query_finds_nearly_all(corpus_spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(corpus_spark, sf, "embeddings").collect()]
    want = brute(rows, 20)
    df = queries.op13_nearest(corpus_spark, sf)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = taken(df)
    assert got.keys() == want.keys()
    value = {i: np.array(v, float) for i, v in rows}
    hits = 0
    for i, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, 21))
        assert all(abs(s - value[i] @ value[j]) < 1e-9 for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for j, _ in want[i][0]})
    assert hits >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("shard, block", [(graph_search.SHARD, graph_search.QUERIES), (40, 3)])
def test_odd_vectors_copies_and_lengths(corpus_spark, shard, block):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(6) * rng.uniform(0.1, 30)).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 9.0]) for i in range(60)]  # copies, many queries among them
    rows += [(400 + i, [float(i % 3 - 1), 0.5]) for i in range(30)] + [(440, [3.0])]
    odd = [(None, [1.0] * 6), (500, None), (520, []), (540, [0.0] * 6), (560, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (580, [float("nan")] * 6), (600, [float("inf")] + [1.0] * 5), (-20, [5.0] * 6)]
    rows += odd + rows[:25]
    df = corpus_spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], ROWS)
    vectors = graph_search.vectors_of(df)
    index = graph_search.build_index(vectors, 21, shard)
    found = graph_search.search(index, vectors.where("vec_id % 20 = 0"), 20, 2000, block)
    got = taken(found)
    want = brute(rows, 20)
    assert got.keys() == {i for i, v in want.items() if v[0]}
    for i, found in got.items():
        assert [j for _, j, _ in found] == [j for j, _ in want[i][0]]
        assert np.allclose([s for _, _, s in found], [s for _, s in want[i][0]], rtol=1e-12)


def test_one_id_with_two_vectors_is_two_queries(corpus_spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    df = corpus_spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], ROWS)
    got = sorted((r["rank"], r.vec_id, r.score) for r in graph_search.nearest(df).collect())
    assert got == [(1, 1, 2.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 1.0)]


def test_empty_tables(corpus_spark):
    df = corpus_spark.createDataFrame([], ROWS)
    assert graph_search.nearest(df).count() == 0
    assert graph_search.nearest(corpus_spark.createDataFrame([(20, [1.0], 1, "x", 2, "y"), (3, None, 1, "x", 2, "y")], ROWS)).count() == 0


def test_every_point_is_in_the_graph():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((40, 5)), 30, axis=0) + 1e-7 * rng.standard_normal((1200, 5))  # tight clusters
    graph = graph_search.Graph(graph_search.levelled(x)[0]).build()
    led_to = set(graph.ways[graph.ways >= 0].tolist()) | set(graph.entry.tolist())
    assert led_to == set(range(len(x)))
