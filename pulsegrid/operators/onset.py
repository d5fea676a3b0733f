"""C11: second peak pass inside long gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.sequence import TRACK, neighbours, running_sum
from pulsegrid.session import stage


def rescue_gaps(
    env: DataFrame, peaks: DataFrame, thresholds: DataFrame, *, min_gap: int, keys: Sequence[str] = TRACK, value: str = "v"
) -> DataFrame:
    """Add the strongest weaker peak inside each gap longer than 1.8 mean gaps.

    ``env`` carries ``is_peak`` (flux rule). A frame's gap is the running count of peaks
    before it, so frames meet their gap by an equality join and one aggregation instead of
    a range join. Only tracks with more than four peaks take part. ``env``, ``peaks`` and
    ``thresholds`` are read several times and should be staged.
    """
    keys = list(keys)
    numbered = stage(running_sum(peaks.select(*keys, "frame_idx"), keys, "frame_idx", {"gap": F.lit(1).cast("long")}), "numbered")
    following = neighbours(numbered, keys, "gap", lambda w: {"next_frame": F.lead("frame_idx").over(w)})
    stats = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), ((F.max("frame_idx") - F.min("frame_idx")) / (F.count(F.lit(1)) - 1)).alias("_mean")
    )
    gaps = (
        following.filter(F.col("next_frame").isNotNull()).join(stats.filter("_n > 4"), keys)
        .filter(F.col("next_frame") - F.col("frame_idx") > F.col("_mean") * 1.8)
        .select(*keys, (F.col("gap") + 1).alias("gap"), (F.col("frame_idx") + min_gap).alias("lo"), (F.col("next_frame") - min_gap).alias("hi"))
    )
    flagged = env.join(peaks.select(*keys, "frame_idx", F.lit(1).cast("long").alias("_hit")), [*keys, "frame_idx"], "left")
    counted = running_sum(flagged, keys, "frame_idx", {"gap": F.coalesce("_hit", F.lit(0)).cast("long")})
    weak = counted.filter("is_peak").join(thresholds, keys).filter(F.col(value) > F.col("threshold") * 0.5)
    inside = weak.join(gaps, [*keys, "gap"]).filter((F.col("frame_idx") >= F.col("lo")) & (F.col("frame_idx") < F.col("hi")))
    best = inside.groupBy(*keys, "gap").agg(F.max_by("frame_idx", F.struct(F.col(value), -F.col("frame_idx"))).alias("frame_idx"))
    return peaks.select(*keys, "frame_idx").unionByName(best.select(*keys, "frame_idx"))
