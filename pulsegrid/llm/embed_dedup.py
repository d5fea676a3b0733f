"""Near-duplicate vectors: random-hyperplane hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare, row_runs
from pulsegrid.llm.components import components
from pulsegrid.llm.simhash import Forest
from pulsegrid.session import stage

THRESHOLD = 0.95
MISS = 1e-4  # accepted chance that a pair right at the threshold shares no bucket
BUCKET = 1024  # vectors of a bucket, at most about, among unrelated vectors
BLOCK = 2048  # larger buckets are compared block by block
STRIPE = 512  # rows of a similarity matrix at once
SEED = 20


def table_sizes(vectors: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a signature and number of tables.

    Bits grow with the logarithm of the number of vectors, so buckets of unrelated vectors stay as small at any size;
    tables are as many as a pair at the threshold needs to meet in one of them but for the chance ``miss``. Each table
    ships every vector once, so large buckets, compared as matrices, are cheaper than many tables.
    """
    bits = min(30, max(4, math.ceil(math.log2(max(2, vectors) / BUCKET))))
    same = (1.0 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def usable(docs: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and the vector's ``bytes`` in its own precision; null where it cannot link (null, zero, not all finite)."""
    kind = precision(docs, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, kind) if v else np.zeros(0)  # a null component reads as nan
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "bytes": pa.array(out, pa.binary())})

    return docs.select("vec_id", F.col(column).cast("array<float>" if kind == "f4" else "array<double>")).mapInArrow(work, f"vec_id {docs.schema['vec_id'].dataType.simpleString()}, bytes binary")


def precision(docs: DataFrame, column: str) -> str:
    return "f4" if docs.schema[column].dataType.simpleString() == "array<float>" else "f8"


def unit(raw: pa.Array, kind: str) -> np.ndarray:
    """Rows of vector bytes, all of one length, in double precision and scaled to length 1 (through their largest
    component, against overflow)."""
    x = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signatures(distinct: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """``distinct`` with one ``bits``-bit sign signature for each table."""
    rep = distinct.schema["rep"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int32)
        for batch in batches:
            raw = batch.column(2)
            sizes = np.array([len(b) for b in raw.to_pylist()], np.int64)
            for size in np.unique(sizes).tolist():
                mine = pa.array(np.flatnonzero(sizes == size))
                planes = np.random.default_rng([SEED, size]).standard_normal((size // int(kind[1]), bits * tables))
                sign = (unit(raw.take(mine), kind) @ planes >= 0).reshape(len(mine), tables, bits)
                found = (sign * weights).sum(axis=2, dtype=np.int32)
                ends = np.arange(0, found.size + 1, tables, dtype=np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"rep": batch.column(0).take(mine), "copies": batch.column(1).take(mine), "bytes": raw.take(mine), "sigs": pa.ListArray.from_arrays(ends, pa.array(found.ravel()))}
                )

    return distinct.select("rep", "copies", "bytes").mapInArrow(work, f"rep {rep}, copies long, bytes binary, sigs array<int>")


def candidates(signed: DataFrame) -> DataFrame:
    """One row per vector, table and block pair: ``grp``, ``t``, ``part`` (0: both sides, 1 or 2: that side only).

    A bucket of up to ``BLOCK`` vectors is one group. A larger one is cut into blocks by a hash of the vector, and each
    two blocks make a group, so no task holds more than two blocks, however many vectors agree.
    """
    dealt = signed.select("rep", "copies", "bytes", "sigs", F.posexplode("sigs").alias("t", "sig")).withColumn("bucket", F.xxhash64("t", "sig", F.length("bytes")))
    counted = signed.select(F.length("bytes").alias("size"), F.posexplode("sigs").alias("t", "sig")).groupBy(F.xxhash64("t", "sig", "size").alias("bucket")).count()
    large = stage(counted.where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    dealt = dealt.join(large, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(9)), F.coalesce("blocks", F.lit(1))).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
        "t",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("part"),
        "rep", "copies", "bytes", "sigs",
    )


def compare(dealt: DataFrame, threshold: float, parts: int, kind: str) -> DataFrame:
    """Verified links of all groups, summed up: ``rep``, ``n`` (rows linked to each row of it), ``b`` (a forest link).

    A pair that shares buckets in several tables counts in the first of them only, which both signatures tell; pairs
    themselves are never written.
    """
    rep = dealt.schema["rep"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_runs(batches, "grp", 4_000):
            grp = rows.column("grp").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]])
            sigs = rows.column("sigs").combine_chunks()
            sig = sigs.flatten().to_numpy().reshape(len(rows), -1)
            copies, side, t = (rows.column(c).to_numpy() for c in ("copies", "part", "t"))
            raw = rows.column("bytes").combine_chunks()
            reps = rows.column("rep").combine_chunks()
            linked = np.zeros(len(rows), np.int64)
            forest = Forest(len(rows))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                x, first = unit(raw.slice(a, b - a), kind), t[a]
                for at in range(0, len(x), STRIPE):
                    i, j = np.nonzero(x[at : at + STRIPE] @ x.T >= threshold)
                    i += at
                    keep = (i < j) & ((side[a + i] != side[a + j]) | (side[a + i] == 0))
                    i, j = i[keep] + a, j[keep] + a
                    fresh = (sig[i, first] == sig[j, first]) & ~(sig[i, :first] == sig[j, :first]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                    np.add.at(linked, i, copies[j])
                    np.add.at(linked, j, copies[i])
                    forest.join(i, j)
            out = np.flatnonzero(linked)
            yield pa.RecordBatch.from_pydict({"rep": reps.take(pa.array(out)), "n": pa.array(linked[out]), "b": reps.take(pa.array(forest.root[out]))})

    return dealt.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(work, f"rep {rep}, n long, b {rep}")


def near_duplicates(vectors: DataFrame, column: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows with equal vectors are one node with a number of copies; ``n_links`` counts rows, the row itself left out.
    Vectors of different lengths never link. Vectors that are null, zero or hold a null or non-finite component, and
    rows with a null id, link with nothing and are kept. Repeated rows count as copies. Other columns are ignored.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    kind = precision(vectors, column)
    rows = stage(usable(vectors, column), "vectors")
    linkable = rows.where("bytes IS NOT NULL AND vec_id IS NOT NULL")
    distinct = stage(linkable.groupBy("bytes").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    bits, tables = table_sizes(distinct.count(), threshold, miss)
    signed = stage(signatures(distinct, bits, tables, kind), "signatures")
    found = stage(compare(candidates(signed), threshold, int(spark.conf.get("spark.sql.shuffle.partitions")), kind), "links")
    named = components(found.select(F.col("rep").alias("a"), "b"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    table = stage(
        distinct.join(counts, "rep", "left")
        .join(named, distinct["rep"] == named["id"], "left")
        .select("bytes", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")),
        "nodes",
    )
    joined = linkable.join(table, "bytes").select("vec_id", "n_links", "component_id")
    alone = rows.where("bytes IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
