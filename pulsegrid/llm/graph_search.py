"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph in each shard.

Different vectors are dealt into shards of bounded size. A task builds the graph of a shard: points enter in batches, a
greedy search over the points before them proposes neighbours, and pruning by a relaxed distance keeps those that lie in
different directions. Blocks of queries walk every shard's graph with a beam; what they find is scored in double
precision. Inside a shard every vector gets one component more that makes all of one length, so the order of distances
is that of inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare
from pulsegrid.session import stage

SHARD = 16_384  # different vectors of one graph, on average at most
QUERIES = 16_384  # queries that walk a graph in one task
DEGREE = 32
POOL = 64  # the beam that proposes neighbours
RELAXED = 1.2  # how much nearer to a kept neighbour than to the point itself a candidate must be to go
FIRST = 64  # points that are compared with all others; the graph grows from them
BATCH = 256  # searches that walk together
WIDTH = 4  # candidates that a search expands at once
BEAM = 160
SEED = 13


def vectors_of(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, raw``: usable vectors as little-endian doubles. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do rows with a null id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")  # null components read as nan
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            some = np.concatenate([[0], np.cumsum(value != 0)])
            good = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            raw = value.tobytes()
            out = [raw[8 * (z - n) : 8 * z] for z, n, ok in zip(ends.tolist(), size.tolist(), good.tolist(), strict=True) if ok]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).filter(pa.array(good)), "raw": pa.array(out, pa.binary())})

    given = rows.where("vec_id IS NOT NULL").select("vec_id", F.col(column).cast("array<double>"))
    return given.mapInArrow(work, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, raw binary")


def matrix(raw: pa.Array) -> np.ndarray:
    """Vectors of one length, one a row."""
    whole = raw.cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], "<f8", (ends[-1] - ends[0]) // 8, ends[0]).reshape(len(whole), -1)


class Graph:
    """Points of one length in space, each with up to ``degree`` ways to others; -1 fills the rest."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, ways: np.ndarray | None = None):
        self.x = np.ascontiguousarray(points, np.float32)
        self.ways = np.full((len(points), degree), -1, np.int32) if ways is None else ways
        self.entry = np.zeros(0, np.int64)

    def walk(self, queries: np.ndarray, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest of the points met, best first, with their scaled similarity; -1 where fewer were met.

        Only the first ``known`` points have ways. A search goes on from its ``WIDTH`` nearest points that it has not yet
        left, until it has left all of its ``beam`` nearest.
        """
        n, start = len(queries), self.entry[self.entry < known]
        seen = np.zeros((n, known + 1), bool)
        seen[:, known] = True  # stands for no way
        ids = np.full((n, beam), known, np.int64)
        near = np.full((n, beam), -np.inf, np.float32)
        ids[:, : len(start)], seen[:, start] = start, True
        near[:, : len(start)] = queries @ self.x[start].T
        left = np.isinf(near)
        active = np.arange(n)
        while len(active):
            score = np.where(left[active], -np.inf, near[active])
            best = np.argpartition(-score, WIDTH - 1, axis=1)[:, :WIDTH] if beam > WIDTH else np.argsort(-score, axis=1)
            usable = np.isfinite(np.take_along_axis(score, best, 1))
            left[active[:, None], best] = True
            source = np.where(usable, np.take_along_axis(ids[active], best, 1), 0)
            found = np.where(usable[:, :, None], self.ways[source], -1).reshape(len(active), -1).astype(np.int64)
            found[found < 0] = known
            found[seen[active[:, None], found]] = known
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = known
            row, at = np.nonzero(found < known)
            point = found[row, at]
            seen[active[row], point] = True
            fresh = np.full(found.shape, -np.inf, np.float32)
            fresh[row, at] = np.einsum("ij,ij->i", self.x[point], queries[active[row]])
            all_ids, all_near = np.concatenate([ids[active], found], axis=1), np.concatenate([near[active], fresh], axis=1)
            all_left = np.concatenate([left[active], np.isinf(fresh)], axis=1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[active], near[active], left[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_near, all_left))
            active = active[~left[active].all(axis=1)]
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        return np.where(np.isinf(near), -1, ids), near

    def prune(self, points: np.ndarray, pool: np.ndarray) -> None:
        """Sets the ways of ``points`` to what robust pruning keeps of their ``pool`` (-1: none): the nearest candidate
        stays, and all that are nearer to it, by the factor ``RELAXED``, than to the point go; and so on."""
        degree, squared = self.ways.shape[1], RELAXED**2
        for at in range(0, len(points), BATCH):
            own, group = points[at : at + BATCH], pool[at : at + BATCH]
            x = self.x[group]
            away = ((x - self.x[own][:, None]) ** 2).sum(axis=2)
            away[(group < 0) | (group == own[:, None])] = np.inf
            between = np.einsum("bij,bkj->bik", x, x, optimize=True)
            norm = np.einsum("bij,bij->bi", x, x)
            between = np.maximum(norm[:, :, None] + norm[:, None] - 2 * between, 0)
            ways = np.full((len(own), degree), -1, np.int32)
            line = np.arange(len(own))
            for k in range(min(degree, group.shape[1])):
                best = away.argmin(axis=1)
                open_ = np.isfinite(away[line, best])
                if not open_.any():
                    break
                ways[open_, k] = group[line, best][open_]
                gone = squared * between[line, best] <= away
                gone[line, best] = True
                away[gone & open_[:, None]] = np.inf
            self.ways[own] = ways

    def build(self) -> Graph:
        """Points enter in their order, each batch as large as half of those before it, and are tied in both directions.

        Walks start at some 64 spread points. A point that no way leads to becomes an entry point of its own, so all
        can be found."""
        n = len(self.x)
        first = min(n, FIRST)
        self.entry = np.arange(first)
        self.prune(self.entry, np.tile(self.entry, (first, 1)))
        at = first
        while at < n:
            new = np.arange(at, min(n, at + max(FIRST, at // 2)))
            pools = [self.walk(self.x[new[k : k + BATCH]], POOL, at)[0] for k in range(0, len(new), BATCH)]
            self.prune(new, np.concatenate(pools))
            self._tie_back(new)
            at = int(new[-1]) + 1
        reached = np.zeros(n + 1, bool)
        reached[self.ways.ravel()] = True
        self.entry = np.union1d(self.entry, np.flatnonzero(~reached[:n]))
        return self

    def _tie_back(self, new: np.ndarray) -> None:
        """Adds the ways back from the neighbours of ``new`` points; points with too many ways are pruned, a few at a time."""
        degree = self.ways.shape[1]
        source = np.repeat(new, degree)
        target = self.ways[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            owner, begin, count = np.unique(target, return_index=True, return_counts=True)
            rank = np.arange(len(target)) - np.repeat(begin, count)
            now = rank < degree
            pool = np.full((len(owner), 2 * degree), -1, np.int64)
            pool[:, :degree] = self.ways[owner]
            pool[np.repeat(np.arange(len(owner)), count)[now], degree + rank[now]] = source[now]
            full = (pool >= 0).sum(axis=1) > degree
            pool = -np.sort(-pool, axis=1)
            self.ways[owner[~full]] = pool[~full, :degree]
            self.prune(owner[full], pool[full])
            source, target = source[~now], target[~now]


def levelled(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors scaled into the unit ball and lifted onto its sphere by one component more, and the scale."""
    scale = float(np.abs(x).max()) * np.sqrt(x.shape[1]) or 1.0
    y = x / scale
    length = (y**2).sum(axis=1)
    most = length.max()
    return np.concatenate([y, np.sqrt(np.maximum(most - length, 0))[:, None]], axis=1) / np.sqrt(most), scale


INDEX = "shard int, width int, number int, entry boolean, raw binary, ids {ids}, ways array<int>"


def build_index(vectors: DataFrame, copies: int, shard: int = SHARD) -> DataFrame:
    """The index as a table, one row per different vector: shard, place in it, its ways, and the smallest ids that hold it.

    ``copies`` ids are kept of each vector: a search for k neighbours never needs more than k + 1, as equal vectors tie
    and the smaller id goes first. Shards hold vectors of one length.
    """
    by_id = Window.partitionBy("raw").orderBy("vec_id")
    distinct = vectors.distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= copies)
    distinct = stage(distinct.groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("width", (F.length("raw") / 8).cast("int")), "distinct")
    sizes = distinct.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = distinct.join(sizes, "width").withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "raw"), F.col("shards")).cast("int"))

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a graph is much work for few bytes, so small tasks are not put together

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()  # the same graph whenever the task runs again
        raw = rows.column("raw").combine_chunks()
        graph = Graph(levelled(matrix(raw))[0]).build()
        n = len(raw)
        flat, size = graph.ways[graph.ways >= 0], (graph.ways >= 0).sum(axis=1)
        entry = np.zeros(n, bool)
        entry[graph.entry] = True
        ways = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
        return pa.table({"shard": rows.column("shard"), "width": rows.column("width"), "number": pa.array(np.arange(n, dtype=np.int32)), "entry": pa.array(entry), "raw": raw, "ids": rows.column("ids"), "ways": ways})

    return stage(dealt.select("shard", "width", F.xxhash64("raw").alias("place"), "raw", "ids").repartition(parts, "width", "shard").groupBy("width", "shard").applyInArrow(work, INDEX.format(ids=distinct.schema["ids"].dataType.simpleString())), "index")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best ids found for each query (``vec_id, raw``), its own id left out.

    Every query walks every shard of its length. Queries are dealt into blocks, and a block and a shard meet in one task,
    so tasks hold a bounded number of both. Each sends on at most ``k`` ids of a query. Repeated queries count once.
    """
    blocks = max(1, -(-queries.count() // block))
    asked = queries.distinct().select(F.col("vec_id").alias("query_id"), F.col("raw").alias("query"), (F.length("raw") / 8).cast("int").alias("width"), F.pmod(F.xxhash64(F.lit(1), "raw", "vec_id"), F.lit(blocks)).cast("int").alias("part"))
    shards = index.select("width", "shard").distinct()
    left = asked.join(shards, "width").select("query_id", "query", F.xxhash64("query").alias("token"), F.col("width").alias("w"), F.col("shard").alias("s"), F.col("part").alias("p"))
    right = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    query_kind, id_kind = queries.schema["vec_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query_id": asked.column("query_id").slice(0, 0), "token": asked.column("token").slice(0, 0), "vec_id": pa.array([], rows.schema.field("ids").type.value_type), "score": pa.array([], pa.float64())})
        rows = rows.sort_by("number").combine_chunks()
        x = matrix(rows.column("raw").combine_chunks())
        lists = rows.column("ways").combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        ways = np.full((len(x), max(1, int(size.max()))), -1, np.int32)
        ways[np.arange(ways.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
        graph = Graph(levelled(x)[0], ways=ways)
        graph.entry = np.flatnonzero(rows.column("entry").to_numpy())
        owned = rows.column("ids").combine_chunks()
        first, flat = owned.offsets.to_numpy().astype(np.int64), owned.flatten()
        first, count = first[:-1] - first[0], np.diff(first)
        query = asked.column("query").combine_chunks()
        q = matrix(query)
        q_flat = np.concatenate([q / np.abs(q).max(axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1).astype(np.float32)
        query_ids, tokens = asked.column("query_id").combine_chunks(), asked.column("token").combine_chunks()
        wide = max(beam, len(graph.entry), k + 1)
        out_query, out_id, out_score = [], [], []
        for at in range(0, len(q), BATCH):
            found, _ = graph.walk(q_flat[at : at + BATCH], wide, len(x))
            row, place = np.nonzero(found >= 0)
            point = found[row, place]
            score = np.einsum("ij,ij->i", x[point], q[at + row])
            # whole groups of copies, then the best k of each query
            owner = np.repeat(np.arange(len(point)), count[point])
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count[point]) - count[point], count[point])
            ids = flat.take(pa.array(first[point][owner] + inner))
            who, score = at + row[owner], score[owner]
            other = pc.not_equal(ids, query_ids.take(pa.array(who))).to_numpy(zero_copy_only=False)
            who, score, ids = who[other], score[other], ids.filter(pa.array(other))
            order = pc.sort_indices(pa.table({"q": pa.array(who), "s": pa.array(score), "i": ids}), [("q", "ascending"), ("s", "descending"), ("i", "ascending")]).to_numpy()
            sorted_who = who[order]
            begin = np.searchsorted(sorted_who, sorted_who, side="left")
            order = order[np.arange(len(order)) - begin < k]
            out_query.append(who[order])
            out_id.append(ids.take(pa.array(order)))
            out_score.append(score[order])
        taken = pa.array(np.concatenate(out_query))
        return pa.table({"query_id": query_ids.take(taken), "token": tokens.take(taken), "vec_id": pa.concat_arrays(out_id), "score": pa.array(np.concatenate(out_score))})

    found = left.groupBy("w", "s", "p").cogroup(right.groupBy("width", "shard", "part")).applyInArrow(work, f"query_id {query_kind}, token long, vec_id {id_kind}, score double")
    best = Window.partitionBy("query_id", "token").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, column: str = "embedding", k: int = 20, every: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest by inner product of every row whose ``vec_id`` is divisible by ``every``, among all other rows.

    ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id; all candidates if fewer were found. A row is
    told by its id and vector: repeated rows count once, and rows with the query's id are its own. Vectors of other
    lengths are not compared. Null, zero, empty or non-finite vectors and null ids take no part; other columns are ignored.
    """
    prepare(rows.sparkSession)
    vectors = stage(vectors_of(rows, column), "vectors")
    return search(build_index(vectors, k + 1, shard), vectors.where(F.col("vec_id") % every == 0), k, beam)
