"""Stereo separation against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import score, segments
from pulsegrid.plans import detect


def resampled(x, ratio):
    x = x.copy()
    if ratio < 1:
        a = ratio / 2
        for i in range(1, len(x) - 1):
            x[i] = a * x[i] + (1 - a) * x[i - 1]
    at = np.arange(int(np.floor(len(x) * ratio))) / ratio
    low = np.floor(at).astype(int)
    return x[low] * (1 - (at - low)) + x[np.minimum(low + 1, len(x) - 1)] * (at - low)


def mid_side(rows):
    """A separator that needs both channels of a segment: middle, side, and two stems of silence."""
    middle, side = rows.sum(axis=1) / 2, (rows[:, 0] - rows[:, 1]) / 2
    stems = np.stack([np.stack([middle, middle], axis=1), np.stack([side, -side], axis=1)], axis=1)
    return np.concatenate([stems, np.zeros_like(stems)], axis=1)


@pytest.mark.parametrize("in_rate, model_rate", [(100, 100), (200, 100), (160, 200)])
def test_both_channels_meet_in_the_separator(spark, in_rate, model_rate):
    rng = np.random.default_rng(4)
    x = rng.uniform(-0.4, 0.4, (900, 2))
    rows = [("t", 2 * k + c, float(x[k, c])) for k in range(900) for c in range(2)] + [("t", 1800, 9.0)]  # the last has no partner
    stems = score.separate_stereo(spark.createDataFrame(rows, "track_id string, idx long, v double"), mid_side, in_rate=in_rate, model_rate=model_rate, length=10_000).collect()
    got = {}
    for r in stems:
        got.setdefault((r.stem, r.ch), {})[r.idx] = r.v
    y = np.stack([resampled(x[:, c], model_rate / in_rate) for c in range(2)], axis=1)
    want = {("drums", 0): y.mean(axis=1), ("drums", 1): y.mean(axis=1), ("bass", 0): (y[:, 0] - y[:, 1]) / 2, ("bass", 1): (y[:, 1] - y[:, 0]) / 2}
    assert len(got) == 8
    for key, values in want.items():
        np.testing.assert_allclose([got[key][k] for k in range(len(y))], values, atol=1e-9)
    assert all(not any(got[stem, c].values()) for stem in ("other", "vocals") for c in range(2))


def test_limit_is_that_of_the_louder_channel(spark):
    rows = [("t", 2 * k + c, (2.0, 0.5)[c]) for k in range(64) for c in range(2)]
    df = spark.createDataFrame(rows, "track_id string, idx long, v double")
    first = lambda x: np.stack([x, 0 * x, 0 * x, 0 * x], axis=1)
    stems = score.separate_stereo(df, first, in_rate=50, model_rate=50, length=1000)
    values = {(r.ch, round(r.v, 9)) for r in stems.filter("stem = 'drums'").collect()}
    assert values == {(0, 0.99), (1, 0.2475)}
    mono = {round(r.v, 9) for r in score.stem_mono(stems).filter("stem = 'drums'").collect()}
    assert mono == {0.61875}


def test_every_stem_is_detected_on(spark):
    rows = [("t", 2 * k + c, float(np.sin(k * (c + 1)) * 0.3)) for k in range(400) for c in range(2)]
    df = spark.createDataFrame(rows, "track_id string, idx long, v double")
    counts = detect.stereo_stem_detector(df, in_rate=100, model_rate=200, length=256, per_stem=True, detector=lambda s: s.groupBy("track_id", "stem").count())
    assert {(r.stem, r["count"]) for r in counts.collect()} == {(stem, 800) for stem in score.STEMS}


def test_only_the_ends_of_segments_are_grouped(spark):
    """Overlap-add keeps no sorted or struct state: its groups hold numbers and half of the samples, in the given parts."""
    rng = np.random.default_rng(8)
    rows = [(t, k, float(v)) for t, n in (("a", 1_000), ("b", 65), ("c", 10)) for k, v in enumerate(rng.standard_normal(n))]
    cut = segments.overlap_segments(spark.createDataFrame(rows, "track_id string, idx long, v double"), length=64)
    sized = cut.join(cut.groupBy("track_id", "seg").agg((F.max("pos") + 1).alias("size")), ["track_id", "seg"])
    plain = segments.overlap_add(cut, length=64)
    dealt = segments.overlap_add(sized, length=64, size="size", partitions=3)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" not in plan, plan
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))
    parts = {}
    for r in cut.orderBy("track_id", "seg", "pos").collect():
        parts.setdefault((r.track_id, r.seg), []).append(r.v)
    want = {}
    for (t, s), own in sorted(parts.items()):
        for p, v in enumerate(own):
            if s > 0 and p < 16:
                w = p / 16 * ((len(own) - 1 - p) / 16 if len(own) >= 16 and p >= len(own) - 16 else 1.0)
                v = want.get((t, s * 48 + p), 0.0) * (1 - w) + v * w
            want[t, s * 48 + p] = v
    got = {(r.track_id, r.idx): r.v for r in plain.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)
