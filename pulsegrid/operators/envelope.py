"""Operators on envelopes: one value per (track, frame)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.operators.sequence import CHUNK, TRACK, order_statistics, over_chunks, with_stats

KEYS = TRACK
IDX = "frame_idx"


def _moving_average(w: WindowSpec, value: str, idx: str, half: int) -> Column:
    chunk = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = (F.min(idx).over(chunk) == 0) & (F.count(F.lit(1)).over(chunk) < 2 * half + 1)
    return F.when(short, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-half, half)))


def moving_average(
    env: DataFrame, *, keys: Sequence[str] = KEYS, idx: str = IDX, value: str = "v", out: str = "s", window: int = 5, size: int = CHUNK
) -> DataFrame:
    """Centred mean over the rows present; series shorter than the window stay as they are."""
    half = window // 2
    return over_chunks(
        env, keys, idx, [lambda w: {out: _moving_average(w, value, idx, half)}], before=half, after=2 * half, size=size
    )


def _is_peak(w: WindowSpec, value: str, rule: str) -> Column:
    left, right, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    tests = {
        "strict": (v > left) & (v > right),
        "flat_right": (v > left) & (v >= right),
        "flat_left": (v >= left) & (v > right),
    }
    return F.coalesce(tests[rule], F.lit(False))


def local_maximum(
    env: DataFrame, *, keys: Sequence[str] = KEYS, idx: str = IDX, value: str = "v", out: str = "is_peak", rule: str = "strict", size: int = CHUNK
) -> DataFrame:
    """``strict`` (energy), ``flat_right`` (flux, onset), ``flat_left`` (model activations)."""
    return over_chunks(env, keys, idx, [lambda w: {out: _is_peak(w, value, rule)}], before=1, after=1, size=size)


def smooth_and_mark(
    env: DataFrame, *, keys: Sequence[str] = KEYS, idx: str = IDX, value: str = "v", window: int = 5, rule: str = "strict", size: int = CHUNK
) -> DataFrame:
    """C1 then C9 on one exchange."""
    half = window // 2
    stages = [
        lambda w: {"s": _moving_average(w, value, idx, half)},
        lambda w: {"is_peak": _is_peak(w, "s", rule)},
    ]
    return over_chunks(env, keys, idx, stages, before=half + 1, after=2 * half + 1, size=size)


def gaussian_kernel(sigma: float) -> list[float]:
    radius = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def gaussian_smooth(
    env: DataFrame, *, sigma: float, keys: Sequence[str] = KEYS, idx: str = IDX, value: str = "v", out: str = "s", size: int = CHUNK
) -> DataFrame:
    """Gaussian kernel with the edge value repeated beyond both ends."""
    if sigma <= 0:
        return env.withColumn(out, F.col(value))
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2

    def smooth(w: WindowSpec) -> dict[str, Column]:
        chunk = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(value).over(chunk), F.last(value).over(chunk)
        total = F.lit(0.0)
        for k, weight in enumerate(kernel, start=-radius):
            moved = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
            total = total + F.coalesce(moved, first if k < 0 else last) * F.lit(weight)
        return {out: total}

    return over_chunks(env, keys, idx, [smooth], before=radius, after=radius, size=size)


def spectral_flux(mags: DataFrame, *, keys: Sequence[str] = KEYS, idx: str = IDX, spectrum: str = "mag", out: str = "v", size: int = 256) -> DataFrame:
    """C3 on array rows: sum of positive magnitude increases against the previous frame."""

    def flux(w: WindowSpec) -> dict[str, Column]:
        previous = F.lag(spectrum).over(w)
        rise = F.zip_with(spectrum, previous, lambda a, b: F.greatest(a - F.coalesce(b, F.lit(0.0)), F.lit(0.0)))
        start = F.transform(spectrum, lambda a: F.greatest(a, F.lit(0.0)))
        parts = F.when(previous.isNull(), start).otherwise(rise)
        return {out: F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)}

    return over_chunks(mags, keys, idx, [flux], before=1, size=size).select(*keys, idx, out)


def max_normalise(env: DataFrame, *, keys: Sequence[str] = KEYS, value: str = "v", out: str = "v") -> DataFrame:
    """C4: divide by the track maximum when it is positive."""
    joined = with_stats(env, keys, _peak=F.max(value))
    scaled = F.when(F.col("_peak") > 0, F.col(value) / F.col("_peak")).otherwise(F.col(value))
    return joined.withColumn(out, scaled).drop("_peak")


def z_normalise(env: DataFrame, *, keys: Sequence[str] = KEYS, value: str = "v", out: str = "v") -> DataFrame:
    """Sample standard deviation; a single frame gives 0."""
    joined = with_stats(env, keys, _mean=F.avg(value), _sd=F.coalesce(F.stddev_samp(value), F.lit(0.0)))
    sd = F.when(F.isnan("_sd"), F.lit(0.0)).otherwise(F.col("_sd"))
    return joined.withColumn(out, (F.col(value) - F.col("_mean")) / (sd + F.lit(1e-9))).drop("_mean", "_sd")


def energy_threshold(env: DataFrame, *, sensitivity: float = 0.5, keys: Sequence[str] = KEYS, value: str = "s") -> DataFrame:
    """One row per track, mean + (1 - 2 * sensitivity) * population standard deviation."""
    level = 1.0 - 2.0 * min(1.0, max(0.0, sensitivity))
    return env.groupBy(*keys).agg((F.avg(value) + F.lit(level) * F.stddev_pop(value)).alias("threshold"))


def iqr_threshold(env: DataFrame, *, keys: Sequence[str] = KEYS, value: str = "v") -> DataFrame:
    """p25 + half the spread, kept between 8 % and 25 % of the maximum."""
    quartiles = order_statistics(env, keys, value, {"p25": "floor(n * 0.25D)", "p75": "floor(n * 0.75D)"})
    stats = env.groupBy(*keys).agg(F.max(value).alias("_max"), F.avg(value).alias("_mean"))
    spread = F.col("p25") + 0.5 * (F.col("p75") - F.col("p25"))
    raw = F.when(F.col("n") < 4, F.greatest(F.col("_mean"), F.col("_max") * 0.12)).otherwise(spread)
    limited = F.least(F.greatest(raw, F.col("_max") * 0.08), F.col("_max") * 0.25)
    return quartiles.join(stats, list(keys)).select(*keys, limited.alias("threshold"))


def _local_threshold(w: WindowSpec, value: str, factor: float, half: int, floor: float) -> Column:
    mean = F.avg(F.greatest(F.col(value), F.lit(0.0))).over(w.rowsBetween(-half, half))
    return F.greatest(mean * F.lit(factor), F.lit(floor))


def local_threshold(
    env: DataFrame, *, factor: float, keys: Sequence[str] = KEYS, idx: str = IDX, value: str = "s", half: int = 3, floor: float = 0.01, size: int = CHUNK
) -> DataFrame:
    """Mean of the positive part over +-half frames times ``factor``, with a floor."""
    return over_chunks(
        env, keys, idx, [lambda w: {"threshold": _local_threshold(w, value, factor, half, floor)}], before=half, after=half, size=size
    )


def peaks_over_local_threshold(
    env: DataFrame, *, factor: float, keys: Sequence[str] = KEYS, idx: str = IDX, value: str = "s", half: int = 3, floor: float = 0.01, size: int = CHUNK
) -> DataFrame:
    """C8 and C9 (flux rule) on one exchange; returns the candidates only."""
    stage = [
        lambda w: {
            "threshold": _local_threshold(w, value, factor, half, floor),
            "is_peak": _is_peak(w, value, "flat_right"),
        }
    ]
    marked = over_chunks(env, keys, idx, stage, before=half, after=half, size=size)
    return marked.filter(F.col("is_peak") & (F.col(value) > F.col("threshold")))
