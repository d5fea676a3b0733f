"""From a beat grid to an ordered multi-clip edit list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import segments, timeline
from pulsegrid.operators.sequence import TRACK, running_sum, with_stats
from pulsegrid.session import stage


def thin_beats(beats: DataFrame, selection: DataFrame, *, rate: int = 0) -> DataFrame:
    """G1 and G2, numbered again; ``orig_idx`` keeps the musical index for effect divisors.

    Each step is written: all join by track, so together they would sort in one task, and each reads its input twice.
    """
    inside = stage(timeline.select_beats(beats, selection), "selected")
    kept = stage(timeline.every_nth(inside, rate), "thinned")
    placed = with_stats(kept, TRACK, _first=F.min("beat_idx"))
    step = 1 << min(3, max(0, rate))
    return placed.select(
        "track_id", F.expr(f"(beat_idx - _first) div {step}").alias("beat_idx"), F.col("beat_idx").alias("orig_idx"), "t"
    )


def edit_list(beats: DataFrame, clips: DataFrame, *, clip: float = 1.0) -> DataFrame:
    """(track_id, seg_no, kind, clip_id, path, src_start, dur, out_start).

    Beat rows take clips in turn, long gaps are filled with whole clips, and both are merged
    in beat order. Row numbers and output times are prefix sums by chunk.
    """
    rows = stage(segments.classify_gaps(beats, clip=clip), "gaps")
    cuts = segments.source_offsets(segments.round_robin(rows, clips), clips)
    cuts = cuts.select("track_id", "beat_idx", F.lit(0).cast("long").alias("piece"), "kind", "clip_id", "src_start", "dur")
    gaps = rows.filter("kind <> 'BEAT'")
    fills = segments.fill_long_gaps(gaps, clips).join(gaps.select("track_id", "beat_idx", "kind"), ["track_id", "beat_idx"])
    fills = fills.select("track_id", "beat_idx", "piece", "kind", "clip_id", F.lit(0.0).alias("src_start"), "dur")
    merged = stage(cuts.unionByName(fills), "merged")
    sizes = merged.groupBy("track_id", (F.col("beat_idx") + 1).alias("_i")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("dur").alias("_d")
    )
    starts = running_sum(sizes, TRACK, "_i", {"_seg": F.col("_n"), "_out": F.col("_d")}).select("track_id", "_i", "_seg", "_out")
    # pieces of one gap follow each other; every piece but the last is a whole clip
    placed = merged.withColumn("_i", F.col("beat_idx") + 1)
    inside = with_pieces(placed)
    out = inside.join(starts, ["track_id", "_i"]).join(clips.select("clip_id", "path"), "clip_id")
    return out.select(
        "track_id", (F.col("_seg") + F.col("piece")).alias("seg_no"), "kind", "clip_id", "path", "src_start", "dur",
        (F.col("_out") + F.col("_before")).alias("out_start"),
    )


def with_pieces(rows: DataFrame) -> DataFrame:
    """Duration of the earlier pieces of the same gap, by chunks of pieces."""
    return running_sum(rows, ["track_id", "_i"], "piece", {"_before": F.col("dur")}, depth=1)
