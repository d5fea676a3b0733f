"""Carried-state operators against plain loops, for chunk sizes that cut everywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from pulsegrid.operators import carry, lookup, segments
from pulsegrid.plans import edit_list


def greedy(at, gap, last=None):
    kept = []
    for x in at:
        if last is None or x - last >= gap:
            kept.append(x)
            last = x
    return kept


def tracks():
    rng = np.random.default_rng(3)
    return {
        "random": np.unique(rng.integers(0, 900, 300)),
        "periodic": np.arange(0, 900, 10),  # two phases that never meet
        "dense": np.arange(5, 600),
        "sparse": np.array([3, 400, 401, 2000]),
        "single": np.array([17]),
    }


@pytest.mark.parametrize("initial", [None, 0.0])
@pytest.mark.parametrize("size", [20, 64, 65_536])
def test_minimum_gap(spark, size, initial, monkeypatch):
    monkeypatch.setattr(carry, "LINKS", 3)
    rows = [(k, int(x), float(x)) for k, xs in tracks().items() for x in xs]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["track_id", "frame_idx", "at"]).sample(frac=1, random_state=1))
    got = carry.minimum_gap(df, ["track_id"], "frame_idx", "at", 18.0, reach=18, initial=initial, size=size).toPandas()
    for k, xs in tracks().items():
        assert sorted(got[got.track_id == k]["at"]) == greedy(xs.astype(float), 18.0, initial), k


@pytest.mark.parametrize("size", [30, 65_536])
def test_minimum_gap_in_seconds(spark, size):
    # 10 frames at 40 frames per second are exactly the gap: rounding must follow the comparison
    xs = np.arange(0, 400, 5)
    df = spark.createDataFrame(pd.DataFrame({"track_id": "a", "frame_idx": xs, "at": xs * 5 / 200.0}))
    got = carry.minimum_gap(df, ["track_id"], "frame_idx", "at", 0.25, reach=12, size=size).toPandas()
    assert sorted(got["at"]) == greedy(xs * 5 / 200.0, 0.25)


def claims(detected, expected, tolerance):
    used, pairs = set(), []
    for i, d in enumerate(detected):
        for j, e in enumerate(expected):
            if j not in used and abs(d - e) <= tolerance:
                used.add(j)
                pairs.append((i, j))
                break
    return pairs


@pytest.mark.parametrize("chunk", [3, 20, 8192])
@pytest.mark.parametrize("span", [1.0, 6.0, 40.0])
def test_match_truth(spark, chunk, span, monkeypatch):
    monkeypatch.setattr(carry, "LINKS", 3)
    rng = np.random.default_rng(5)
    d, e = np.sort(rng.uniform(0, span, 160)), np.sort(rng.uniform(0, span, 150))
    e[::7] = d[: len(e[::7])] + 0.05  # window borders, where the comparison rounds
    e = np.sort(e)
    det = spark.createDataFrame(pd.DataFrame({"track_id": "a", "beat_idx": range(len(d)), "t": d}))
    exp = spark.createDataFrame(pd.DataFrame({"track_id": "a", "truth_idx": range(len(e)), "t": e}))
    got = lookup.match_truth(det, exp, tolerance=0.05, chunk=chunk).toPandas()
    assert sorted(zip(got.beat_idx, got.truth_idx)) == claims(d, e, 0.05)


def fill(gaps, lengths):
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    out, at = [], 0
    for beat, dur in gaps:
        left, piece = dur, 0
        while dur >= 0.1 and left > 0.1:
            clip = order[at % len(order)]
            use = min(lengths[clip], left)
            out.append((beat, piece, clip, round(use, 9)))
            left -= use
            at += 1
            piece += 1
    return out


def test_states_by_doubling_are_those_one_by_one():
    rng = np.random.default_rng(21)
    for n in (1, 2, 3, 17, 400):
        for _ in range(40):
            a = np.sort(rng.integers(0, max(2, n // rng.integers(1, 5)), n))
            b = np.maximum.accumulate(np.maximum(a, a + rng.integers(0, 4, n)))
            low, high = lookup.held_between(a, b)
            for p in {0, int(a[0]), int(rng.integers(0, b[0] + 1)), int(b[0])}:
                got = np.clip(p, low, high) + np.arange(1, n + 1)
                for k in range(n):
                    p = max(p, a[k])
                    p += p < b[k]
                    assert got[k] == p


def test_a_long_track_is_matched_without_a_loop(spark):
    """Detections as dense as a window holds, so most of them compete; the state runs through several chunks."""
    n = 400_000
    det = spark.range(n).selectExpr("1 AS track_id", "id AS beat_idx", "id * 0.01D AS t")
    exp = spark.range(n // 3).selectExpr("1 AS track_id", "id AS truth_idx", "id * 0.03D + 0.004D AS t")
    got = lookup.match_truth(det, exp, tolerance=0.05).agg(F.count("*"), F.countDistinct("truth_idx"), F.max("truth_idx"), F.sum("beat_idx")).first()
    t, truth, p, total = np.arange(n) * 0.01, np.arange(n // 3) * 0.03 + 0.004, 0, 0
    first, last = np.searchsorted(truth, t - 0.05 - 1e-12), np.searchsorted(truth, t + 0.05 + 1e-12)
    claimed = 0
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        p = max(p, a)
        if p < b:
            p, claimed, total = p + 1, claimed + 1, total + k
    assert tuple(got) == (claimed, claimed, p - 1, total)


@pytest.mark.parametrize("chunk", [2, 4096])
def test_fill_long_gaps(spark, chunk, monkeypatch):
    monkeypatch.setattr(carry, "LINKS", 2)
    rng = np.random.default_rng(8)
    gaps = [(int(b), float(np.round(rng.uniform(0.05, 9), 2))) for b in np.unique(rng.integers(-1, 60, 30))]
    lengths = [2.5, 0.7, 3.1, 2.5, 1.3]
    df = spark.createDataFrame(pd.DataFrame([("a", b, d) for b, d in gaps], columns=["track_id", "beat_idx", "dur"]))
    clips = spark.createDataFrame(pd.DataFrame({"clip_id": range(5), "duration": lengths, "path": list("vwxyz")}))
    got = segments.fill_long_gaps(df, clips, chunk=chunk).toPandas()
    rows = sorted((int(r.beat_idx), int(r.piece), int(r.clip_id), round(r.dur, 9)) for r in got.itertuples())
    assert rows == sorted(fill(gaps, lengths))
    with pytest.raises(ValueError):
        segments.fill_long_gaps(df, clips.limit(0))


def test_edit_list_is_contiguous(spark):
    t = np.cumsum([4.0] + [0.5] * 20 + [6.0] + [0.5] * 10)
    beats = spark.createDataFrame(pd.DataFrame({"track_id": "a", "beat_idx": range(len(t)), "t": t}))
    clips = spark.createDataFrame(pd.DataFrame({"clip_id": range(3), "duration": [2.0, 3.0, 1.0], "path": ["x", "y", "z"]}))
    out = edit_list.edit_list(beats, clips, clip=1.0).orderBy("seg_no").toPandas()
    assert out.seg_no.tolist() == list(range(len(out)))
    np.testing.assert_allclose(out.out_start, np.concatenate([[0], np.cumsum(out.dur)[:-1]]), atol=1e-9)
    assert out.kind.iloc[0] == "INTRO" and (out.kind == "BREAKDOWN").sum() == 3


@pytest.mark.parametrize("partitions", [None, 5])
def test_last_region_at(spark, partitions):
    rng = np.random.default_rng(2)
    probes = pd.DataFrame({"track_id": 1, "probe_id": range(200), "t": np.round(rng.uniform(-1, 20, 200), 1)})
    start = np.round(rng.uniform(0, 19, 60), 1)
    regions = pd.DataFrame({"track_id": 1, "region_id": range(60), "start_s": start, "end_s": start + np.round(rng.uniform(-0.2, 4, 60), 1)})
    got = lookup.last_region_at(spark.createDataFrame(probes), spark.createDataFrame(regions), partitions=partitions).toPandas()
    want = {}
    for p in probes.itertuples():
        inside = regions[(regions.start_s <= p.t) & (regions.end_s >= p.t)]
        want[p.probe_id] = int(inside.region_id.max()) if len(inside) else -1
    assert dict(zip(got.probe_id, got.region_id)) == want


@pytest.mark.parametrize("tie,expected", [("later", [0, 1, 1, 2, 2]), ("earlier", [0, 0, 1, 1, 2])])
def test_nearest_ties(spark, tie, expected):
    beats = spark.createDataFrame(pd.DataFrame({"track_id": 1, "beat_idx": [0, 1, 2], "t": [1.0, 2.0, 3.0]}))
    probes = spark.createDataFrame(pd.DataFrame({"track_id": 1, "probe_id": range(5), "t": [0.2, 1.5, 2.0, 2.5, 9.0]}))
    got = lookup.nearest_beat(probes, beats, tie=tie).orderBy("probe_id").toPandas()
    assert got.nearest_idx.tolist() == expected
    alone = lookup.nearest_beat(probes, beats.filter("track_id = 7")).toPandas()
    assert (alone.nearest_t == 0.0).all()
