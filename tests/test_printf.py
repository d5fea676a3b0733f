"""Numbers in texts as the SQL's printf writes them: of the binary value, not of its shortest decimal text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.rounding import printf
from pulsegrid.operators import segments
from pulsegrid.sources import sinks


def test_ties_of_the_shortest_text(spark):
    values = [k / 1e7 for k in range(5, 40_000, 10)] + [0.5, 2.0**-7, -0.0000005, 0.0, 1e-12, 1e22]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "k long, v double")
    got = {r.k: r.x for r in rows.select("k", printf("%.6f", F.col("v")).alias("x")).collect()}
    assert got.pop(-1) is None
    assert got == {k: f"{v:.6f}" for k, v in enumerate(values)}


def test_window_expressions(spark):
    times = [k + 0.0000005 * (2 * k + 1) for k in range(70)]
    beats = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "track_id long, beat_idx long, t double")
    got = {r.chunk: r.enable for r in segments.window_expressions(beats, width=0.08).collect()}
    want = [f"between(t,{t:.6f},{t + 0.08:.6f})" for t in times]
    assert got == {c: "+".join(want[30 * c : 30 * c + 30]) for c in range(3)}


def test_reports(spark):
    times = [0.0005, 61.0015, 122.0025, 183.0035, 6000.9995, 60 * 7 + 59.9996]
    beats = spark.createDataFrame([(1, k, t) for k, t in enumerate(times)], "track_id long, beat_idx long, t double")
    assert [r.text for r in sinks.grid_report(beats).orderBy("beat_idx").collect()] == [f"{t:.3f}" for t in times]
    clocks = [r.clock for r in sinks.clock_report(beats).orderBy("beat_idx").collect()]
    assert clocks == [f"{int(t // 60):2d}:{t - t // 60 * 60:6.3f}" for t in times]


def test_filter_numbers(spark):
    values = [0.1234565, 1.000005, 12.34565, 1e-7, 3e6, 250.0, 4 / 3]
    rows = [(k, False, "x", False, 1.0, True, v) for k, v in enumerate(values)]
    configs = spark.createDataFrame(rows, "k long, enable_color boolean, preset string, enable_vignette boolean, vignette double, enable_blur boolean, blur double")
    got = [r.chain for r in segments.filter_chain(configs).orderBy("k").collect()]
    assert got == [f"gblur=sigma={v:.6g}" for v in values]
