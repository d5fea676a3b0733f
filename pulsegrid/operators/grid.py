"""Beat-grid generation and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.lookup import nearest_beat
from pulsegrid.operators.sequence import TRACK, counted, dense_index, neighbours, order_statistics
from pulsegrid.operators.tempo import dominant_interval
from pulsegrid.session import stage

SLACK = 1e-9  # float tolerance when counting grid steps
BPM_RANGE = (20.0, 300.0)


def clamp_hint(bpm: Column) -> Column:
    """Hints of 0 or less are off, others are kept within 20-300."""
    return F.when(bpm <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(bpm, F.lit(BPM_RANGE[0])), F.lit(BPM_RANGE[1])))


def even_steps(rows: DataFrame, start: Column, step: Column, end: Column) -> DataFrame:
    """Explode ``start + i * step`` for every i with the time before ``end``."""
    count = F.greatest(F.ceil((end - start) / step - F.lit(SLACK)), F.lit(0))
    sized = rows.withColumns({"_t0": start, "_step": step, "_n": count.cast("long")})
    return counted(sized, "_n", "beat_idx").withColumn("t", F.col("_t0") + F.col("beat_idx") * F.col("_step"))


def even_grid(anchors: DataFrame) -> DataFrame:
    """``anchors(track_id, first_beat, bpm, duration)`` with bpm > 0 after clamping."""
    hinted = anchors.withColumn("bpm", clamp_hint(F.col("bpm"))).filter("bpm > 0")
    grid = even_steps(hinted, F.col("first_beat"), F.lit(60.0) / F.col("bpm"), F.col("duration"))
    return grid.select("track_id", "beat_idx", "t")


def regrid(anchors: DataFrame) -> DataFrame:
    """A first beat at or past the end restarts at 0; BPM outside 20-300 is ignored."""
    valid = anchors.filter(F.col("bpm").between(*BPM_RANGE) & (F.col("duration") > 0))
    start = F.when(F.col("first_beat") >= F.col("duration"), F.lit(0.0)).otherwise(F.col("first_beat"))
    grid = even_steps(valid, start, F.lit(60.0) / F.col("bpm"), F.col("duration"))
    return grid.select("track_id", "beat_idx", "t")


def halve_or_double(bpm: Column, action: Column) -> Column:
    """New tempo, or null when the button has no effect."""
    return F.when((action == "half") & (bpm > 40), bpm / 2).when((action == "double") & (bpm > 0) & (bpm < 150), bpm * 2)


def reanalysis_override(beats: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(track_id, analysed, user_bpm, detected_bpm, duration)``.

    A track already analysed whose requested tempo is valid and differs by more than 0.5 is
    laid out evenly from its first beat; the others keep their beats.
    """
    first = beats.groupBy("track_id").agg(F.min("t").alias("first_beat"), F.max("t").alias("last_beat"))
    changed = F.col("analysed") & F.col("user_bpm").between(*BPM_RANGE) & (F.abs(F.col("user_bpm") - F.col("detected_bpm")) > 0.5)
    wanted = requests.filter(changed).join(first, "track_id")
    step = F.lit(60.0) / F.col("user_bpm")
    end = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.col("last_beat") + step)
    even = even_steps(wanted, F.col("first_beat"), step, end).select("track_id", "beat_idx", "t")
    kept = beats.join(requests.filter(changed).select("track_id"), "track_id", "left_anti").select("track_id", "beat_idx", "t")
    return even.unionByName(kept)


def fill_gaps(beats: DataFrame, durations: DataFrame, *, keys: Sequence[str] = TRACK, t: str = "t") -> DataFrame:
    """E5: interpolate missing beats and extend both ends; returns (keys, t, filled).

    ``t`` must be in seconds. Tracks with fewer than four beats or without a valid interval
    come back unchanged.
    """
    keys = list(keys)
    gaps = neighbours(beats, keys, "beat_idx", lambda w: {"_next": F.lead(t).over(w), "_prev": F.lag(t).over(w)})
    rows = gaps.withColumn("x", F.col(t) - F.col("_prev")).filter(F.col("x").isNotNull())
    step = dominant_interval(rows, low=0.15, high=1.5, bins_per_second=100, for_gaps=True, keys=keys)
    ends = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"), F.min(t).alias("_first"), F.max(t).alias("_last"))
    plan = step.select(*keys, F.col("best").alias("_step")).join(ends.filter("_count >= 4"), keys).join(durations, keys)
    plan = stage(plan, "fill-plan")  # one row per track, used three times
    gap, unit = F.col("_next") - F.col(t), F.col("_step")
    missing = F.floor(gap / unit + 0.5) - 1
    inner = (
        gaps.filter(F.col("_next").isNotNull()).join(plan.select(*keys, "_step"), keys)
        .filter((gap > unit * 1.5) & (missing > 0) & (missing < 8))
        .withColumn("_m", missing.cast("long"))
        .withColumn("_j", F.explode(F.expr("sequence(1L, _m)")))
        .select(*keys, (F.col(t) + F.col("_j") * ((F.col("_next") - F.col(t)) / (F.col("_m") + 1))).alias(t))
    )
    lead_in = F.ceil((F.col("_first") - 0.1) / unit - F.lit(SLACK)) - 1
    head = (
        plan.filter((F.col("_first") > unit * 1.5) & (unit > 0)).withColumn("_m", lead_in.cast("long")).filter("_m > 0")
    )
    head = counted(head, "_m", "_k", keys).select(*keys, (F.col("_first") - (F.col("_k") + 1) * unit).alias(t))
    lead_out = F.ceil((F.col("duration") - 0.1 - F.col("_last")) / unit - F.lit(SLACK)) - 1
    tail = (
        plan.filter(unit >= 0.1).withColumn("_m", lead_out.cast("long")).filter("_m > 0")
    )
    tail = counted(tail, "_m", "_k", keys).select(*keys, (F.col("_last") + (F.col("_k") + 1) * unit).alias(t))
    filled = inner.unionByName(head).unionByName(tail).withColumn("filled", F.lit(True))
    return beats.select(*keys, t).withColumn("filled", F.lit(False)).unionByName(filled)


def add_beats(beats: DataFrame, additions: DataFrame, durations: DataFrame) -> DataFrame:
    """Add beats with 0 <= t <= duration and number the grid again."""
    valid = additions.join(durations, "track_id").filter((F.col("t") >= 0) & (F.col("t") <= F.col("duration")))
    rows = beats.select("track_id", "t", F.lit(0).alias("src"), F.col("beat_idx").alias("n")).unionByName(
        valid.select("track_id", "t", F.lit(1).alias("src"), F.col("edit_id").alias("n"))
    )
    return dense_index(rows, TRACK, ["t", "src", "n"], "beat_idx").select("track_id", "beat_idx", "t", (F.col("src") == 1).alias("added"))


def remove_nearest(beats: DataFrame, edits: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """Each edit removes the beat strictly closer than ``tolerance``; the earliest wins a tie.

    ``edits(track_id, edit_id, t)`` are resolved against the grid as it is before the batch.
    """
    near = nearest_beat(edits, beats, probe_id="edit_id", tie="earlier")
    hits = near.filter(F.col("distance") < tolerance).select("track_id", F.col("nearest_idx").alias("beat_idx")).distinct()
    return beats.join(hits, ["track_id", "beat_idx"], "left_anti").select("track_id", "beat_idx", "t")


def move_beats(beats: DataFrame, edits: DataFrame, durations: DataFrame) -> DataFrame:
    """``edits(track_id, beat_idx, new_t)`` replace the time, clamped to [0, duration]; numbers stay."""
    joined = beats.join(edits, ["track_id", "beat_idx"], "left").join(durations, "track_id")
    moved = F.least(F.greatest(F.col("new_t"), F.lit(0.0)), F.col("duration"))
    return joined.select("track_id", "beat_idx", F.coalesce(moved, F.col("t")).alias("t"))


def detector_fallback(results: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Per track keep the beats of the best-ranked detector that found any.

    The ranking is a handful of labels; the winner per track is a partial aggregate.
    """
    rank = F.lit(None).cast("int")
    for name, level in priority.items():
        rank = F.when(F.col("detector") == name, F.lit(level)).otherwise(rank)
    ranked = results.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = ranked.groupBy("track_id").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["track_id", "_rank"]).drop("_rank")


def stem_fallback(stems: DataFrame, mix: DataFrame, *, stem: str = "drums") -> DataFrame:
    """The drums stem where a track has one, else the full mix."""
    chosen = stems.filter(F.col("stem") == stem)
    missing = mix.join(chosen.select("track_id").distinct(), "track_id", "left_anti")
    return chosen.select("track_id", "idx", "v", F.lit(stem).alias("origin")).unionByName(
        missing.select("track_id", "idx", "v", F.lit("mix").alias("origin"))
    )
