"""Data-quality checks; each returns the offending rows or a status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.sequence import TRACK, neighbours


def not_ascending(beats: DataFrame) -> DataFrame:
    """L1."""
    back = neighbours(beats, TRACK, "beat_idx", lambda w: {"prev_t": F.lag("t").over(w)})
    return back.filter(F.col("t") <= F.col("prev_t")).select("track_id", "beat_idx", "t", "prev_t")


def beats_without_bpm(summary: DataFrame) -> DataFrame:
    """L2."""
    return summary.filter((F.col("n_beats") > 0) & ~(F.coalesce("bpm", F.lit(0.0)) > 0))


def peaks_out_of_range(peaks: DataFrame) -> DataFrame:
    """L3."""
    return peaks.filter((F.col("peak") < 0) | (F.col("peak") > 1))


def silent_tracks_with_beats(samples: DataFrame, beats: DataFrame) -> DataFrame:
    """L4."""
    silent = samples.groupBy("track_id").agg(F.max(F.abs("v")).alias("peak")).filter("peak = 0")
    return beats.join(silent, "track_id", "left_semi")


def silent_tracks_without_beats(samples: DataFrame, beats: DataFrame) -> DataFrame:
    silent = samples.groupBy("track_id").agg(F.max(F.abs("v")).alias("peak")).filter("peak = 0")
    return silent.select("track_id").join(beats, "track_id", "left_anti")


def bpm_outside(summary: DataFrame, *, low: float = 110.0, high: float = 130.0) -> DataFrame:
    """L5."""
    return summary.filter(~F.col("bpm").between(low, high))


def analysis_status(results: DataFrame) -> DataFrame:
    """L6."""
    return results.withColumn("status", F.when(F.coalesce("duration", F.lit(0.0)) <= 0, "failed").otherwise("ok"))
