"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import stage

BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
BATCH_TEXT = 8 << 20  # bytes of text that Python code handles at once
SLOTS = 1 << 24  # bits of a sieve: 262,144 rows of 64 at most, whatever the size of the tables
_HELD: list[Callable[[], None]] = []  # how to drop what this Python worker remembers from task to task


def prepare(spark: SparkSession) -> None:
    """Session settings of the corpus operators: small Arrow batches, as texts may be long, and no stale shuffle files."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
    # what a staged step has shuffled is of no use once its files are written
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def remember(drop: Callable[[], None]) -> None:
    """Called where a worker begins to remember something between tasks, ``drop`` lets go of it. Only the latest is held."""
    forget()
    _HELD.append(drop)


def forget() -> None:
    """Drop what earlier tasks of other steps have left in this Python worker, as Spark hands its workers on from step to step."""
    if not _HELD:
        return
    while _HELD:
        _HELD.pop()()
    gc.collect()
    pa.default_memory_pool().release_unused()


def unburdened(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of a task that uses nothing remembered: it begins with ``forget``."""

    def run(batches: Iterator) -> Iterator:
        forget()
        yield from work(batches)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_TEXT) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of a batch holding about ``limit`` bytes of text each, with their texts (null: empty).

    A single longer text makes a range of its own; texts are never cut.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The integers ``start[i] .. start[i] + length[i] - 1`` for every i, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(start.astype(np.int64) - (ends - length), length)


def borders(df: DataFrame, key: str, buckets: int, per_bucket: int = 40) -> list:
    """At most ``buckets - 1`` ascending values of ``key`` that cut the rows into parts of like size.

    Only ``buckets * per_bucket`` sampled keys reach the driver, whatever the size of ``df``. The borders steer
    where rows go, never what comes out.
    """
    total = df.count()
    share = max(1, total // (buckets * per_bucket))
    drawn = df.where(F.pmod(F.xxhash64(F.lit(0), F.col(key)), F.lit(share)) == 0).select(key).limit(buckets * per_bucket * 4)
    values = sorted(r[0] for r in drawn.collect() if r[0] is not None)
    if not values:
        return []
    return sorted({values[len(values) * i // buckets] for i in range(1, buckets)})


def bucket_of(key: Column, cuts: list) -> Column:
    """Number of borders at or below ``key``; null keys go to bucket 0."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= key)), F.lit(0))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashed ``key`` column for ``sifted``: at most ``SLOTS / 64`` rows, so it may be broadcast."""
    slots = keys.select(F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot"))
    return stage(slots.groupBy(F.expr("_slot div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(_slot % 64)))").alias("_bits")), "sieve")


def sifted(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: true for every row whose ``key`` is among the sieve's keys, and for some others.

    Goes before an exact join, so that rows which cannot match are not shuffled for it.
    """
    found = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(SLOTS))).join(F.broadcast(bitmap), F.expr("_slot div 64") == F.col("_word"), "left")
    return found.withColumn("_hit", F.expr("coalesce(getbit(_bits, int(_slot % 64)), 0) = 1")).drop("_slot", "_word", "_bits")


def row_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup sorted batches so that rows of one ``key`` are never parted; tables hold about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        keys = joined.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if last:
            yield joined.slice(0, last)
        rest = joined.slice(last)
        held, size = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
