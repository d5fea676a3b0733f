"""Tempo and regularity: aggregates over beats and intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.sequence import CHUNK, TRACK, neighbours, order_statistics, with_stats


def intervals(beats: DataFrame, *, keys: Sequence[str] = TRACK, idx: str = "beat_idx", t: str = "t", size: int = CHUNK) -> DataFrame:
    """Time since the previous beat; the first beat has none."""
    gaps = neighbours(beats, keys, idx, lambda w: {"x": F.col(t) - F.lag(t).over(w)}, size=size)
    return gaps.filter(F.col("x").isNotNull())


def upper_median(rows: DataFrame, *, keys: Sequence[str] = TRACK, value: str = "x", few_distinct: bool = False) -> DataFrame:
    """The element at n div 2 in ascending order."""
    return order_statistics(rows, keys, value, {"median": "n div 2"}, few_distinct=few_distinct)


def mode_bin(rows: DataFrame, *, bins_per_second: int, keys: Sequence[str] = TRACK, value: str = "x") -> DataFrame:
    """D3: most frequent bin, lowest on ties; ``mode`` is its lower edge."""
    counts = rows.groupBy(*keys, F.expr(f"bigint({value} * {bins_per_second})").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    best = F.max_by(F.struct("bin", "count"), F.struct(F.col("count"), -F.col("bin")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.bin").alias("bin"), F.col("b.count").alias("count"), (F.col("b.bin") / float(bins_per_second)).alias("mode")
    )


def mode_or_median(stats: DataFrame, *, for_gaps: bool = False) -> Column:
    """Two different support rules, one for tempo and one for gap filling."""
    support = F.greatest(F.lit(1), F.expr("n div 5"))
    if for_gaps:
        return F.when(F.col("count") < support, F.col("median")).otherwise(F.col("mode"))
    return F.when(F.col("count") > support, F.col("mode")).otherwise(F.col("median"))


def dominant_interval(rows: DataFrame, *, low: float, high: float, bins_per_second: int, for_gaps: bool, keys: Sequence[str] = TRACK) -> DataFrame:
    """D2-D4 over intervals strictly between ``low`` and ``high``."""
    valid = rows.filter((F.col("x") > low) & (F.col("x") < high))
    stats = upper_median(valid, keys=keys).join(mode_bin(valid, bins_per_second=bins_per_second, keys=keys), list(keys))
    return stats.withColumn("best", mode_or_median(stats, for_gaps=for_gaps))


def tempo_candidates(rows: DataFrame, best: DataFrame, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """Score x, 2x and x/2; the first of the best scores wins."""
    valid = rows.filter((F.col("x") > 0.2) & (F.col("x") < 2.0)).join(best.select(*keys, "best"), list(keys))

    def match(candidate: Column) -> Column:
        ratio = F.col("x") / candidate
        near = F.floor(ratio + 0.5)
        hit = (near >= 1) & (near <= 4) & (F.abs(ratio - near) / near < 0.05)
        return F.avg(F.when(hit, 1.0).otherwise(0.0))

    options = [F.col("best"), F.col("best") * 2.0, F.col("best") / 2.0]
    scored = valid.groupBy(*keys, "best").agg(*[match(c).alias(f"_s{i}") for i, c in enumerate(options)])
    in_range = [(c >= 0.2) & (c <= 2.0) for c in options]
    entries = F.array_compact(
        F.array(*[F.when(ok & (F.col(f"_s{i}") > 0), F.struct(F.col(f"_s{i}").alias("s"), F.lit(-i).alias("o"), c.alias("c"))) for i, (c, ok) in enumerate(zip(options, in_range))])
    )
    top = F.array_max(entries)
    return scored.select(
        *keys, F.coalesce(top["c"], F.col("best")).alias("candidate"), F.coalesce(top["s"], F.lit(0.0)).alias("score")
    )


def octave_fold(bpm: Column) -> Column:
    """Halve above 180, then double below 70; 0 stays 0."""
    down = F.when(bpm > 180, bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / 180.0)))).otherwise(bpm)
    return F.when((down > 0) & (down < 70), down * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(70.0) / down)))).otherwise(down)


def bpm_from_median(median: Column) -> Column:
    """60 over the median interval, 0 without one."""
    return F.when(median > 0, F.lit(60.0) / median).otherwise(F.lit(0.0))


def median_bpm(beats: DataFrame, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """D6 for every track that has beats."""
    medians = upper_median(intervals(beats, keys=keys), keys=keys).select(*keys, "median")
    return beats.select(*keys).distinct().join(medians, list(keys), "left").select(*keys, bpm_from_median(F.col("median")).alias("bpm"))


def grid_summary(beats: DataFrame, set_bpm: DataFrame | None = None, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """Count, duration, average interval and BPM (a set value wins)."""
    base = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_beats"), F.max("t").alias("duration"), F.min("t").alias("_first"))
    average = F.when(F.col("n_beats") > 1, (F.col("duration") - F.col("_first")) / (F.col("n_beats") - 1)).otherwise(0.0)
    base = base.withColumn("avg_interval", average)
    derived = F.when(F.col("avg_interval") > 0, F.lit(60.0) / F.col("avg_interval")).otherwise(0.0)
    if set_bpm is not None:
        base = base.join(set_bpm.select(*keys, F.col("bpm").alias("_set")), list(keys), "left")
        derived = F.when(F.col("_set") > 0, F.col("_set")).otherwise(derived)
    return base.withColumn("bpm", derived).select(*keys, "n_beats", "bpm", "duration", "avg_interval")


def regularity(rows: DataFrame, *, keys: Sequence[str] = TRACK, few_distinct: bool = False) -> DataFrame:
    """1 - 2 * rms deviation from the median over the median; 0 for ten beats or fewer."""
    medians = upper_median(rows, keys=keys, few_distinct=few_distinct)
    spread = rows.join(medians, list(keys)).groupBy(*keys, "median", "n").agg(F.avg(F.pow(F.col("x") - F.col("median"), 2.0)).alias("_var"))
    score = F.greatest(F.lit(0.0), 1.0 - F.sqrt("_var") / F.col("median") * 2.0)
    return spread.select(*keys, F.when(F.col("n") + 1 > 10, score).otherwise(0.0).alias("confidence"))


def filtered_average_interval(rows: DataFrame, *, fallback: float, keys: Sequence[str] = TRACK) -> DataFrame:
    """Mean of intervals strictly between 0.05 and 5 s."""
    inside = F.when((F.col("x") > 0.05) & (F.col("x") < 5.0), F.col("x"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(inside), F.lit(fallback)).alias("avg_interval"))


def span_statistics(spans: DataFrame) -> DataFrame:
    """Pair the n-th START with the n-th END of a (thread, name), then aggregate by name.

    Lines carry ``line_no`` so that spans of one thread pair up in order. Durations come with
    the END line; a START without an END counts as open.
    """
    counts = spans.groupBy("name", "thread").agg(
        F.sum(F.when(F.col("kind") == "START", 1).otherwise(0)).alias("starts"),
        F.sum(F.when(F.col("kind") == "END", 1).otherwise(0)).alias("ends"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
    )
    # n-th START pairs with n-th END, so the number of pairs is the smaller count
    return counts.groupBy("name").agg(
        F.sum(F.least("starts", "ends")).cast("long").alias("spans"),
        F.sum(F.greatest(F.col("starts") - F.col("ends"), F.lit(0))).cast("long").alias("open_spans"),
        (F.sum("total_ms") / F.sum("ends")).alias("avg_ms"),
        F.max("max_ms").alias("max_ms"),
    )


def device_usage(samples: DataFrame) -> DataFrame:
    """Peak and mean utilisation and memory per device."""
    return samples.groupBy("index", "name").agg(
        F.max("util").alias("max_util"), F.avg("util").alias("avg_util"), F.max("mem_used").alias("max_mem"), F.avg("mem_used").alias("avg_mem")
    )


def detector_rollup(beats: DataFrame, bpm: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row per (track, detector)."""
    keys = ["track_id", "detector"]
    return (
        beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_beats"))
        .join(bpm, keys, "left").join(confidence, keys, "left")
        .select(*keys, "n_beats", F.coalesce("bpm", F.lit(0.0)).alias("bpm"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    )
