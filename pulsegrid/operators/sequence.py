"""Order-dependent building blocks that never need a whole track in one task.

Every operator below works on rows keyed by ``keys`` (usually ``track_id``) with an order.
One track may hold a large share of all rows, so none of them opens a window over a whole
track of rows:

* ``ordered_prefix`` / ``dense_index`` - running sums and positions over a range sort;
* ``over_chunks``  - bounded-frame windows on (track, chunk) with copied border rows;
* ``running_sum``  - prefix sums from chunk totals, recursively;
* ``order_statistics`` - exact order statistics by position in a range sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import stage

CHUNK = 8192
TRACK = ("track_id",)


def _changes(batch: pa.RecordBatch, keys: Sequence[str], previous: tuple | None) -> np.ndarray:
    """True where a row starts a new key run within this sorted partition."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        if batch.num_rows > 1:
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
    new[0] = first != previous
    return new


def run_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers where a new run of equal ``keys`` begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for key in keys:
        column = table.column(key)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
    return np.flatnonzero(new)


def _partition_prefix(keys: Sequence[str], names: Sequence[str]):
    """Per sorted partition: exclusive running sums that restart at each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        previous, carry = None, dict.fromkeys(names, 0)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            new = _changes(batch, keys, previous)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            arrays = list(batch.columns)
            for name in names:
                weight = batch.column(batch.schema.get_field_index(f"_w_{name}")).to_numpy(zero_copy_only=False)
                before = np.cumsum(weight) - weight
                local = np.where(start >= 0, before - before[np.maximum(start, 0)], before + carry[name])
                carry[name] = local[-1] + weight[-1]
                arrays.append(pa.array(local.astype(weight.dtype)))
            arrays.append(pa.array(np.full(n, part, dtype=np.int32)))
            previous = tuple(batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays(
                arrays, names=list(batch.schema.names) + [f"_l_{x}" for x in names] + ["_part"]
            )

    return run


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    *,
    partitions: int | None = None,
) -> DataFrame:
    """Add exclusive running sums of non-negative ``sums`` in (keys, order) order.

    A range sort on (keys, order) spreads a hot key over many partitions. Each partition
    adds up its own runs in one streaming pass; the sorted result is written once, because
    range borders are sampled and would otherwise differ between evaluations. Only keys
    that cross a partition border need an offset: at most two per partition, so the
    broadcast below is bounded by the number of partitions, not by the data.
    ``order`` must be unique within a key.
    """
    keys, order = list(keys), list(order)
    for name, value in sums.items():
        df = df.withColumn(f"_w_{name}", value)
    lead = [partitions] if partitions else []
    ranged = df.repartitionByRange(*lead, *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType(
        list(ranged.schema.fields)
        + [T.StructField(f"_l_{n}", ranged.schema[f"_w_{n}"].dataType) for n in sums]
        + [T.StructField("_part", T.IntegerType())]
    )
    local = stage(ranged.mapInArrow(_partition_prefix(keys, list(sums)), schema), "prefix")
    totals = local.groupBy(*keys, "_part").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in sums])
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_n", F.count(F.lit(1)).over(per_key))
        .withColumns({f"_o_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums})
        .filter(F.col("_n") > 1)
        .select(*keys, "_part", *[f"_o_{n}" for n in sums])
    )
    joined = local.join(F.broadcast(offsets), [*keys, "_part"], "left")
    return joined.select(
        *[c for c in df.columns if not c.startswith("_w_")],
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, partitions: int | None = None
) -> DataFrame:
    """0-based position of each row within its key."""
    return ordered_prefix(df, keys, order, {name: F.lit(1).cast("long")}, partitions=partitions)


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    stages: Sequence[Callable[[WindowSpec], dict[str, Column]]],
    *,
    before: int = 0,
    after: int = 0,
    size: int = CHUNK,
) -> DataFrame:
    """Windows with bounded frames, evaluated per (keys, chunk of a dense index).

    ``before``/``after`` border rows are copied into the neighbouring chunk, so the result
    is the same as a window over the whole key while a task holds ``size`` rows at a time.
    ``stages`` run one after another on the same exchange; the border must cover the sum
    of their frames.
    """
    if max(before, after) > size:
        raise ValueError("border rows must fit in a chunk")
    home = F.expr(f"{idx} div {size}")
    offset = F.expr(f"{idx} % {size}")
    homes = [home]
    if before:
        homes.append(F.when(offset >= size - before, home + 1))
    if after:
        homes.append(F.when((offset < after) & (home > 0), home - 1))
    spread = df.withColumn("_home", home)
    spread = (
        spread.withColumn("_chunk", F.explode(F.array_compact(F.array(*homes))))
        if len(homes) > 1
        else spread.withColumn("_chunk", home)
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    for make in stages:
        spread = spread.withColumns(make(w))
    return spread.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def neighbours(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Callable[[WindowSpec], dict[str, Column]], *, size: int = CHUNK
) -> DataFrame:
    """``lag``/``lead`` by one row."""
    return over_chunks(df, keys, idx, [cols], before=1, after=1, size=size)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    sums: dict[str, Column],
    *,
    size: int = CHUNK,
    depth: int = 2,
) -> DataFrame:
    """Exclusive running sums along ``idx``, from chunk totals of chunk totals.

    With ``depth`` levels the only window without a size limit sees ``rows / size**depth`` rows.
    """
    level = f"_c{depth}"
    base = df.withColumn(level, F.expr(f"{idx} div {size}")).withColumns({f"_v_{n}_{depth}": v for n, v in sums.items()})
    inner = Window.partitionBy(*keys, level).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({n: F.coalesce(F.sum(f"_v_{n}_{depth}").over(inner), F.lit(0)) for n in sums})
    totals = base.groupBy(*keys, level).agg(*[F.sum(f"_v_{n}_{depth}").alias(f"_s_{n}") for n in sums])
    if depth > 1:
        offsets = running_sum(
            totals, keys, level, {f"_o_{n}_{depth}": F.col(f"_s_{n}") for n in sums}, size=size, depth=depth - 1
        )
    else:
        outer = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumns(
            {f"_o_{n}_{depth}": F.coalesce(F.sum(f"_s_{n}").over(outer), F.lit(0)) for n in sums}
        )
    offsets = offsets.select(*keys, level, *[f"_o_{n}_{depth}" for n in sums])
    return (
        local.join(offsets, [*keys, level])
        .withColumns({n: F.col(n) + F.col(f"_o_{n}_{depth}") for n in sums})
        .select(*df.columns, *sums)
    )


def with_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-key aggregates (partial aggregation, then a plain join AQE may split or broadcast)."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(keys))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: dict[str, str],
    *,
    few_distinct: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Exact order statistics per key: ``positions`` maps a name to a 0-based SQL rank in ``n``.

    Equal values are counted before anything is sorted. The distinct values are then ranked
    by a range sort, so a key of any size stays spread over the cluster. ``few_distinct``
    ranks them in one window per key instead; use it only when the number of distinct
    values per key is small by construction (integer gaps, histogram bins).
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    if few_distinct:
        below = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("_lo", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        counted = ranked.withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)))
    else:
        ranked = ordered_prefix(counts, keys, ["_x"], {"_lo": F.col("_n")}, partitions=partitions)
        counted = with_stats(ranked, keys, n=F.sum("_n"))
    counted = counted.withColumns({f"_p_{name}": F.expr(f"bigint({p})") for name, p in positions.items()})
    hit = {
        name: (F.col(f"_p_{name}") >= F.col("_lo")) & (F.col(f"_p_{name}") < F.col("_lo") + F.col("_n"))
        for name in positions
    }
    return counted.groupBy(*keys, "n").agg(*[F.max(F.when(hit[name], F.col("_x"))).alias(name) for name in positions])


def counted(rows: DataFrame, count: str, out: str, keys: Sequence[str] = TRACK, block: int = 4096) -> DataFrame:
    """Repeat each row ``count`` times, numbered from 0 in ``out``; rows with a count of 0 or less go.

    Long counts are expanded in two steps with a shuffle between, so one long track does not expand inside one task.
    """
    blocks = rows.filter(F.col(count) > 0).withColumn("_b", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {block})")))
    inside = F.expr(f"sequence(_b * {block}L, least((_b + 1) * {block}L, {count}) - 1)")
    return blocks.repartition(*keys, "_b").withColumn(out, F.explode(inside)).drop("_b")
