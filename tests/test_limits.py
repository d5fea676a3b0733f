"""No operator cuts its result at a size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import grid, segments, signal


def test_grid_of_two_million_beats(spark):
    anchors = spark.createDataFrame([(1, 0.0, 300.0, 400_000.0)], "track_id long, first_beat double, bpm double, duration double")
    assert grid.regrid(anchors).agg(F.count("*"), F.max("beat_idx")).first()[:] == (2_000_000, 1_999_999)


def test_three_thousand_pads(spark):
    clips = spark.range(7).withColumnRenamed("id", "clip_id")
    totals = spark.createDataFrame([(1, 5, 10.0, 6_010.0)], "track_id long, n_segments long, total double, duration double")
    got = segments.pad_to_length(totals, clips).agg(F.count("*"), F.sum("dur"), F.max("segment")).first()
    assert got[:] == (3_000, 6_000.0, 3_004)


def test_many_transition_inputs(spark):
    jobs = spark.createDataFrame([(1, 150, "a", 0.3), (2, 1, "b", 0.3), (3, 20_000, "c", 0.3)], "job long, n_inputs int, path string, duration double")
    assert segments.transition_edges(jobs).count() == 149 + 19_999
    graphs = {r.job: r.graph for r in segments.transition_chain(jobs, "job").collect()}
    assert graphs[1].count(";") == 148 and graphs[2] == "" and graphs[3].endswith("[t19999]")


def test_transition_texts_stay_with_their_rows(spark):
    """The planner takes a text for 20 bytes, so a join by job broadcasts all of them."""
    rows = [(1, 3, "a'b", 0.3), (2, 1, "b", 0.3), (3, 0, "b", 0.3), (4, None, "b", 0.3), (5, 2, "c", 1.25)]
    jobs = spark.createDataFrame(rows, "job long, n_inputs long, path string, duration double")
    made = segments.transition_chain(jobs, "job")
    assert made.columns == [*jobs.columns, "graph"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan, plan
    part = r"gltransition=source='a\'b':duration=0.300"
    want = {1: f"[0:v][1:v]{part}[t1];[t1][2:v]{part}[t2]", 2: "", 3: "", 4: "", 5: "[0:v][1:v]gltransition=source='c':duration=1.250[t1]"}
    assert {r.job: r.graph for r in made.collect()} == want


def test_thirty_thousand_clips(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(5, 400, 30_000) / 64
    gaps = rng.integers(300, 3_000, 40) / 64
    clips = spark.createDataFrame([(int(k), float(d)) for k, d in enumerate(lengths)], "clip_id long, duration double")
    rows = spark.createDataFrame([(1, int(7 * k), float(d)) for k, d in enumerate(gaps)], "track_id long, beat_idx long, dur double")
    got = segments.fill_long_gaps(rows, clips).orderBy("beat_idx", "piece").collect()
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    want, at = [], 0
    for k, gap in enumerate(gaps):
        left, piece = gap, 0
        while left > 0.1:
            used = min(lengths[order[at]], left)
            want.append((1, 7 * k, piece, order[at], used))
            left, piece, at = left - used, piece + 1, (at + 1) % len(order)
    assert [tuple(r) for r in got] == want


def test_a_million_clips(spark):
    """Fills run past the end of the cycle and on; lengths are whole 64ths, so sums are exact."""
    n = 1_000_000
    clips = spark.range(n).selectExpr("id AS clip_id", "(5 + id * 7919 % 396) / 64D AS duration")
    rows = spark.createDataFrame([(1, k, d) for k, d in enumerate([9.0, 2_000_000.0, 0.05, 1_300_000.5, 77.25])] + [(2, 4, 12.0)], "track_id long, beat_idx long, dur double")
    got = segments.fill_long_gaps(rows, clips).groupBy("track_id", "beat_idx").agg(F.count("*").alias("n"), F.sum("dur").alias("d"), F.max("piece").alias("last"), F.sum("clip_id").alias("ids")).collect()
    lengths = (5 + np.arange(n) * 7919 % 396) / 64
    order = np.lexsort((np.arange(n), -lengths))
    sums, want, at = np.concatenate([[0], np.cumsum(np.tile(lengths[order], 3))]), {}, 0
    for k, dur in enumerate([9.0, 2_000_000.0, 0.05, 1_300_000.5, 77.25]):
        many = int(np.searchsorted(sums, sums[at] + dur - 0.1)) - at if dur > 0.1 else 0
        if many:
            want[1, k] = (many, min(dur, sums[at + many] - sums[at]), many - 1, int(np.tile(order, 3)[at : at + many].sum()))
        at = (at + many) % n
    many = int(np.searchsorted(sums, 11.9))
    want[2, 4] = (many, min(12.0, sums[many]), many - 1, int(order[:many].sum()))
    assert {(r.track_id, r.beat_idx): (r.n, r.d, r["last"], r.ids) for r in got} == want


def test_one_pole_of_a_tiny_ratio(spark):
    x = np.random.default_rng(2).standard_normal(3_000)
    samples = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "track_id long, idx long, v double")
    got = [r.v for r in signal.one_pole(samples, ratio=0.005).orderBy("idx").collect()]
    want, a = [x[0]], 0.0025
    for v in x[1:]:
        want.append(a * v + (1 - a) * want[-1])
    want[-1] = x[-1]
    assert np.allclose(got, want, atol=1e-12)
