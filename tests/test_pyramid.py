"""Peak pyramids and bars against plain maxima."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pulsegrid.operators import timeline

COLUMNS = ["bass", "mid"]


def peaks_of(n, seed):
    rng = np.random.default_rng(seed)
    bass, mid = rng.uniform(0, 1.3, n), rng.uniform(-0.5, 1, n)
    return [(k, float(bass[k]), None if k % 11 == 3 else float(mid[k])) for k in range(n) if k % 97 != 50]


def best(rows, lo, hi):
    held = [r for r in rows if lo <= r[0] < hi]
    return tuple(min(max(max((r[c] for r in held if r[c] is not None), default=0.0), 0.0), 1.0) for c in (1, 2))


@pytest.mark.parametrize("block_levels", [1, 3, 12])
def test_levels_and_bars(spark, block_levels):
    tracks = {"a": peaks_of(1000, 1), "b": peaks_of(1, 2), "c": peaks_of(257, 3)}
    df = spark.createDataFrame([(t, *r) for t, rows in tracks.items() for r in rows], "track_id string, bucket long, bass double, mid double")
    levels, sizes = timeline.peak_pyramid(df, COLUMNS, block_levels=block_levels)
    got = {(r.track_id, r.level, r.bucket): (r.bass, r.mid) for r in levels.collect()}
    assert len(got) == levels.count()
    for (t, level, bucket), values in got.items():
        held = [r for r in tracks[t] if r[0] >> level == bucket]
        assert values == tuple(max((r[c] for r in held if r[c] is not None), default=None) for c in (1, 2))
    assert all((t, level, r[0] >> level) in got for t, rows in tracks.items() for r in rows for level in range(max(rows)[0].bit_length() + 1))

    views = [(t, v, 10.0, zoom, scroll) for t in tracks for v, (zoom, scroll) in enumerate([(1.0, 0.0), (3.3, 0.4), (50.0, 0.77), (0.1, -1.0)])] + [("c", 9, 0.0, 1.0, 0.0)]
    bars = timeline.viewport_bars(levels, sizes, spark.createDataFrame(views, "track_id string, view_id int, duration double, zoom double, scroll double"), COLUMNS, width=20).collect()
    want = {}
    for t, v, duration, zoom, scroll in views:
        if duration > 0:
            n, zoom = max(tracks[t])[0] + 1, min(max(zoom, 1.0), 50.0)
            a = min(max(scroll, 0.0), 1 - 1 / zoom) * duration
            b = min(a + duration / zoom, duration)
            lo, hi = max(0, math.floor(a / duration * n) - 1), min(n, math.ceil(b / duration * n) + 1)
            step = max(1, max(1, math.ceil((hi - lo) / 20)) // 2)
            bar = max(1.0, 20.0 * step / (hi - lo + 1))
            for i in range(lo, hi, step):
                x = (i / n * duration - a) / (b - a) * 20
                if -bar <= x <= 20 + bar:
                    want[t, v, i] = best(tracks[t], i, min(i + step, hi))
    assert {(r.track_id, r.view_id, r.peak_idx): (r.bass, r.mid) for r in bars} == want


def test_no_peaks(spark):
    levels, sizes = timeline.peak_pyramid(spark.createDataFrame([], "track_id string, bucket long, bass double, mid double"), COLUMNS)
    assert levels.count() == sizes.count() == 0
