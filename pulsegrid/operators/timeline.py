"""Filters and projections on timelines (selections, regions, viewport, checks)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.sequence import TRACK, with_stats
from pulsegrid.session import stage


def _clamp(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def select_beats(beats: DataFrame, selection: DataFrame, *, rebase: bool = True) -> DataFrame:
    """G1: keep start <= t <= end; an end of 0 or less means the track duration."""
    end = F.when(F.col("sel_end") > 0, F.col("sel_end")).otherwise(F.col("duration"))
    inside = beats.join(selection, "track_id").filter((F.col("t") >= F.col("sel_start")) & (F.col("t") <= end))
    t = F.col("t") - F.col("sel_start") if rebase else F.col("t")
    return inside.select("track_id", "beat_idx", t.alias("t"))


def beat_divisor(rate: Column) -> Column:
    """1, 2, 4 or 8 for a beat rate clamped to 0..3."""
    return F.element_at(F.array(*[F.lit(1 << k) for k in range(4)]), _clamp(rate, F.lit(0), F.lit(3)).cast("int") + 1)


def every_nth(selected: DataFrame, rate: int, *, edited: bool = False) -> DataFrame:
    """Every 2^rate-th beat, counted from the first selected one (edited beats: by raw index).

    Selected beats are consecutive, so a beat's place is its index minus the smallest one.
    The original index is kept for later divisors.
    """
    step = 1 << min(3, max(0, rate))
    if edited:
        return selected.filter(F.col("beat_idx") % step == 0)
    placed = with_stats(selected, TRACK, _first=F.min("beat_idx"))
    return placed.filter((F.col("beat_idx") - F.col("_first")) % step == 0).drop("_first")


def effect_beats(beats: DataFrame, *, divisor: Column, start: Column, end: Column) -> DataFrame:
    """Original index divisible by ``divisor``; bounds apply only where they are above 0."""
    keep = (divisor <= 1) | (F.col("beat_idx") % divisor == 0)
    return beats.filter(keep & ((start <= 0) | (F.col("t") >= start)) & ((end <= 0) | (F.col("t") <= end)))


def clamp_selection(selection: DataFrame) -> DataFrame:
    """G4."""
    start = _clamp(F.col("sel_start"), F.lit(0.0), F.col("duration"))
    clamped = selection.withColumn("sel_start", start)
    return clamped.withColumn("sel_end", _clamp(F.col("sel_end"), F.col("sel_start"), F.col("duration")))


def clamp_regions(regions: DataFrame, selection: DataFrame) -> DataFrame:
    """Start into the selection, end between the new start and the selection end."""
    end = F.when(F.col("sel_end") < 0, F.col("duration")).otherwise(F.col("sel_end"))
    joined = regions.join(selection, "track_id").withColumn("_e", end)
    joined = joined.withColumn("start_s", _clamp(F.col("start_s"), F.col("sel_start"), F.col("_e")))
    return joined.withColumn("end_s", _clamp(F.col("end_s"), F.col("start_s"), F.col("_e"))).select(*regions.columns)


def first_region_bounds(selection: DataFrame, regions: DataFrame) -> DataFrame:
    """The first region relative to the selection start; without regions 0 and -1."""
    first = regions.groupBy("track_id").agg(F.min_by(F.struct("start_s", "end_s"), "region_id").alias("r"))
    joined = selection.join(first, "track_id", "left")
    return joined.select(
        "track_id",
        F.coalesce(F.greatest(F.lit(0.0), F.col("r.start_s") - F.col("sel_start")), F.lit(0.0)).alias("effect_start"),
        F.coalesce(F.col("r.end_s") - F.col("sel_start"), F.lit(-1.0)).alias("effect_end"),
    ).withColumn("effect_start", F.when(F.col("effect_end").isNull(), 0.0).otherwise(F.col("effect_start")))


def add_regions(regions: DataFrame, additions: DataFrame, selection: DataFrame) -> DataFrame:
    """G7 add: new regions are clamped to the selection and enabled."""
    return regions.unionByName(clamp_regions(additions, selection).withColumn("enabled", F.lit(True)))


def remove_regions(regions: DataFrame, removals: DataFrame) -> DataFrame:
    """G7 remove by id."""
    return regions.join(removals.select("track_id", "region_id"), ["track_id", "region_id"], "left_anti")


def clear_regions(regions: DataFrame, tracks: DataFrame) -> DataFrame:
    """G7 clear: drop every region of the given tracks."""
    return regions.join(tracks.select("track_id").distinct(), "track_id", "left_anti")


def visible_range(views: DataFrame) -> DataFrame:
    """``views(duration, zoom, scroll)`` to clamped zoom, scroll and [vis_start, vis_end]."""
    zoom = _clamp(F.col("zoom"), F.lit(1.0), F.lit(50.0))
    scroll = _clamp(F.col("scroll"), F.lit(0.0), F.lit(1.0) - F.lit(1.0) / F.col("zoom"))
    ranged = views.withColumn("zoom", zoom).withColumn("scroll", scroll)
    empty = F.col("duration") <= 0
    start = F.col("scroll") * F.col("duration")
    return ranged.withColumns({
        "vis_start": F.when(empty, 0.0).otherwise(start),
        "vis_end": F.when(empty, 0.0).otherwise(F.least(start + F.col("duration") / F.col("zoom"), F.col("duration"))),
    })


def pixel_to_time(x: Column, width: Column) -> Column:
    """G9 on rows with vis_start, vis_end and duration."""
    span = F.col("vis_end") - F.col("vis_start")
    return F.when((width <= 0) | (F.col("duration") <= 0), 0.0).otherwise(F.col("vis_start") + (x / width) * span)


def time_to_pixel(t: Column, width: Column) -> Column:
    """G9."""
    span = F.col("vis_end") - F.col("vis_start")
    return F.when((F.col("duration") <= 0) | (span <= 0), 0.0).otherwise(((t - F.col("vis_start")) / span) * width)


def viewport_peaks(peaks: DataFrame, views: DataFrame, *, width: int) -> DataFrame:
    """Visible peaks (one extra each side), max per step, clamped to [0, 1]."""
    counts = peaks.groupBy("track_id").agg((F.max("bucket") + 1).alias("_n"))
    ranged = visible_range(views).join(counts, "track_id").filter("duration > 0")
    lo = F.greatest(F.lit(0), F.floor(F.col("vis_start") / F.col("duration") * F.col("_n")) - 1)
    hi = F.least(F.col("_n"), F.ceil(F.col("vis_end") / F.col("duration") * F.col("_n")) + 1)
    per_pixel = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(width)))
    step = F.greatest(F.lit(1).cast("long"), F.floor(per_pixel / 2).cast("long"))
    bounds = ranged.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).withColumn("_step", step)
    inside = peaks.join(bounds.select("track_id", "_lo", "_hi", "_step"), "track_id").filter("bucket >= _lo AND bucket < _hi")
    place = F.expr("(bucket - _lo) div _step * _step + _lo")
    return inside.groupBy("track_id", place.alias("peak_idx")).agg(_clamp(F.max("peak"), F.lit(0.0), F.lit(1.0)).alias("peak"))


def peak_pyramid(peaks: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = TRACK, block_levels: int = 12) -> tuple[DataFrame, DataFrame]:
    """Maxima of 2^level buckets for every level, and (keys, n_peaks).

    (keys, level, bucket, columns) with level 0 as given; each level has half the rows of the one below, so all together
    have twice those of ``peaks``. A task builds ``block_levels`` levels of one aligned block, and the tops of all blocks
    are the input of the next round, so a track of any length takes a shuffle per ``block_levels`` levels. Null values
    count for nothing, and blocks without a value have no row. Meant to be written once and read by many views.
    """
    keys, columns = list(keys), list(columns)
    size = 1 << block_levels
    out = T.StructType([*[peaks.schema[k] for k in keys], T.StructField("level", T.IntegerType()), T.StructField("bucket", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

    def levels(base: int):
        def work(rows: pa.Table) -> pa.Table:
            at = rows.column("bucket").to_numpy()
            block = int(at[0]) // size
            values = np.full((len(columns), size), -np.inf)
            for k, name in enumerate(columns):
                np.fmax.at(values[k], at - block * size, rows.column(name).to_numpy().astype(float))
            parts = []
            for up in range(block_levels + 1):
                if up or not base:
                    held = np.flatnonzero(np.isfinite(values).any(axis=0))
                    parts.append((np.full(len(held), base + up), held + (block << (block_levels - up)), values[:, held]))
                values = np.maximum(values[:, ::2], values[:, 1::2]) if up < block_levels else values
            level, bucket, held = (np.concatenate(p, axis=-1) for p in zip(*parts))
            own = {k: rows.column(k).take(pa.array(np.zeros(len(level), np.int64))) for k in keys}
            shown = {c: pa.array(held[k], mask=~np.isfinite(held[k])) for k, c in enumerate(columns)}
            return pa.table({**own, "level": pa.array(level.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int64)), **shown})

        return work

    rows = peaks.select(*keys, F.col("bucket").cast("long").alias("bucket"), *[F.col(c).cast("double").alias(c) for c in columns])
    sizes = stage(rows.groupBy(*keys).agg((F.max("bucket") + 1).alias("n_peaks")), "peak-counts")
    longest = sizes.agg(F.max("n_peaks")).first()[0] or 0
    made, base = [], 0
    while base == 0 or longest > 1 << base:
        built = stage(rows.groupBy(*keys, F.expr(f"bucket div {size}").alias("_block")).applyInArrow(levels(base), out), "pyramid")
        made.append(built)
        base += block_levels
        rows = built.filter(F.col("level") == base).drop("level")
    return reduce(DataFrame.unionByName, made), sizes


def viewport_bars(levels: DataFrame, sizes: DataFrame, views: DataFrame, columns: Sequence[str], *, width: int) -> DataFrame:
    """The bars of each view (``track_id, view_id, duration, zoom, scroll``) from a ``peak_pyramid``.

    One bar per step of peaks, one extra peak at each side: (track_id, view_id, peak_idx, x, bar_width, columns), each
    column the step's maximum clamped to [0, 1]. A step is the union of at most two blocks of each level below its own
    length, so a view asks for O(width * log(step)) entries, however many peaks lie under it. Bars off the view go.
    """
    ranged = visible_range(views).join(sizes, "track_id").filter("duration > 0")
    lo = F.greatest(F.lit(0), F.floor(F.col("vis_start") / F.col("duration") * F.col("n_peaks")) - 1)
    hi = F.least(F.col("n_peaks"), F.ceil(F.col("vis_end") / F.col("duration") * F.col("n_peaks")) + 1)
    bounds = ranged.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).withColumn("_n", F.col("_hi") - F.col("_lo"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.greatest(F.lit(1), F.ceil(F.col("_n") / width)) / 2).cast("long"))
    stepped = bounds.withColumn("_step", step).filter("_n > 0").withColumn("bar_width", F.greatest(F.lit(1.0), F.lit(float(width)) * F.col("_step") / (F.col("_n") + 1)))
    bars = stepped.withColumn("peak_idx", F.explode(F.expr("sequence(_lo, _hi - 1, _step)")))
    bars = bars.withColumn("x", time_to_pixel(F.col("peak_idx") / F.col("n_peaks") * F.col("duration"), F.lit(float(width))))
    bars = bars.filter((F.col("x") >= -F.col("bar_width")) & (F.col("x") <= width + F.col("bar_width")))
    asked = bars.withColumns({"_from": F.col("peak_idx"), "_to": F.least(F.col("peak_idx") + F.col("_step"), F.col("_hi"))})
    asked = asked.withColumn("level", F.explode(F.expr("sequence(0, cast(floor(log2(_to - _from)) as int))")))
    asked = asked.withColumns({"_l": F.expr("shiftright(_from + shiftleft(1L, level) - 1, level)"), "_r": F.expr("shiftright(_to, level)")})
    ends = F.array_compact(F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1)))
    asked = asked.filter("_l < _r").withColumn("bucket", F.explode(ends)).select("track_id", "view_id", "peak_idx", "x", "bar_width", "level", "bucket")
    found = asked.join(levels, ["track_id", "level", "bucket"], "left")
    maxima = [_clamp(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0), F.lit(1.0)).alias(c) for c in columns]
    return found.groupBy("track_id", "view_id", "peak_idx", "x", "bar_width").agg(*maxima)


def config_error(df: DataFrame) -> DataFrame:
    """2 for a missing transition type while transitions are on or a divisor <= 0, else 0."""
    bad = (F.col("enable_transitions") & F.col("transition_type").isNull()) | (F.col("divisor") <= 0)
    return df.withColumn("error_code", F.when(F.coalesce(bad, F.lit(False)), 2).otherwise(0))


def effect_intensity(flash: Column, zoom: Column) -> tuple[Column, Column]:
    """G12."""
    return _clamp(flash, F.lit(0.1), F.lit(1.0)), _clamp(zoom, F.lit(0.01), F.lit(0.15))


def audio_trim(df: DataFrame) -> DataFrame:
    """Clip only if end > 0 and end > start + 1 ms."""
    clip = (F.col("audio_end") > 0) & (F.col("audio_end") > F.col("audio_start") + 1e-3)
    return df.withColumns({
        "clip_start": F.greatest(F.lit(0.0), F.col("audio_start")),
        "clip_audio": clip,
        "clip_dur": F.when(clip, F.col("audio_end") - F.col("audio_start")).otherwise(0.0),
    })


def frame_count(df: DataFrame) -> DataFrame:
    """G14."""
    derived = F.when((F.col("duration") > 0) & (F.col("fps") > 0), (F.col("duration") * F.col("fps")).cast("long")).otherwise(F.lit(0))
    return df.withColumn("total_frames", F.when(F.col("nb_frames") == 0, derived).otherwise(F.col("nb_frames")).cast("long"))
