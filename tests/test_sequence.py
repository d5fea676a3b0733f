"""Building blocks: results must not depend on chunk sizes, partitions or input order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import envelope, signal
from pulsegrid.operators.sequence import dense_index, order_statistics, ordered_prefix, running_sum


def series(spark, lengths, seed=0, shuffle=True):
    rng = np.random.default_rng(seed)
    rows = [(f"t{k}", i, float(np.round(rng.normal(), 3))) for k, n in enumerate(lengths) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["track_id", "frame_idx", "v"])
    if shuffle:
        pdf = pdf.sample(frac=1.0, random_state=seed)
    return spark.createDataFrame(pdf), pdf.sort_values(["track_id", "frame_idx"]).reset_index(drop=True)


def collect(df, *cols):
    return df.select("track_id", *cols).toPandas().sort_values(["track_id", cols[0]]).reset_index(drop=True)


@pytest.mark.parametrize("partitions", [None, 1, 3, 11])
def test_ordered_prefix_matches_cumulative_sums(spark, partitions):
    # one track holds most rows and so spans several range partitions
    df, pdf = series(spark, [700, 1, 40, 0, 3])
    df = df.withColumn("w", (F.abs(F.col("frame_idx") * 7) % 5).cast("long")).withColumn("d", F.lit(0.5))
    got = collect(ordered_prefix(df, ["track_id"], ["v", "frame_idx"], {"n": F.col("w"), "h": F.col("d")}, partitions=partitions), "frame_idx", "n", "h")
    pdf = pdf.assign(w=(pdf.frame_idx * 7) % 5).sort_values(["track_id", "v", "frame_idx"])
    pdf["n"] = pdf.groupby("track_id").w.cumsum() - pdf.w
    pdf["h"] = pdf.groupby("track_id").cumcount() * 0.5
    want = pdf.sort_values(["track_id", "frame_idx"]).reset_index(drop=True)
    assert got.n.tolist() == want.n.tolist()
    assert got.h.tolist() == want.h.tolist()


def test_dense_index_survives_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df, pdf = series(spark, [300, 20])
        got = collect(dense_index(df, ["track_id"], ["frame_idx"], "pos", partitions=4), "frame_idx", "pos")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got.pos.tolist() == pdf.frame_idx.tolist()


@pytest.mark.parametrize("size,depth", [(4, 1), (4, 3), (1000, 2)])
def test_running_sum(spark, size, depth):
    df, pdf = series(spark, [100, 5])
    got = collect(running_sum(df, ["track_id"], "frame_idx", {"s": F.abs("v")}, size=size, depth=depth), "frame_idx", "s")
    want = pdf.v.abs().groupby(pdf.track_id).cumsum() - pdf.v.abs()
    np.testing.assert_allclose(got.s, want, atol=1e-9)


@pytest.mark.parametrize("few", [True, False])
def test_order_statistics_with_ties(spark, few):
    pdf = pd.DataFrame({"track_id": ["a"] * 9 + ["b"], "x": [5.0, 1, 1, 1, 1, 1, 2, 9, 9, 4]})
    got = order_statistics(spark.createDataFrame(pdf), ["track_id"], "x", {"median": "n div 2", "p75": "floor(n * 0.75D)"}, few_distinct=few, partitions=3)
    rows = {r.track_id: (r.n, r.median, r.p75) for r in got.collect()}
    assert rows == {"a": (9, 1.0, 5.0), "b": (1, 4.0, 4.0)}


def brute_average(values):
    if len(values) < 5:
        return list(values)
    return [np.mean(values[max(0, i - 2) : i + 3]) for i in range(len(values))]


@pytest.mark.parametrize("size", [5, 16, 8192])
def test_moving_average_borders(spark, size):
    df, pdf = series(spark, [4, 5, 17, 33, 1])
    got = collect(envelope.moving_average(df, size=size), "frame_idx", "s")
    want = np.concatenate([brute_average(g.v.to_numpy()) for _, g in pdf.groupby("track_id")])
    np.testing.assert_allclose(got.s, want, atol=1e-12)


def brute_gauss(values, sigma):
    kernel = envelope.gaussian_kernel(sigma)
    radius = len(kernel) // 2
    n = len(values)
    return [sum(values[min(max(i + k, 0), n - 1)] * kernel[k + radius] for k in range(-radius, radius + 1)) for i in range(n)]


@pytest.mark.parametrize("size", [7, 8192])
def test_gaussian_borders(spark, size):
    df, pdf = series(spark, [3, 7, 30, 1])
    got = collect(envelope.gaussian_smooth(df, sigma=1.5, size=size), "frame_idx", "s")
    want = np.concatenate([brute_gauss(g.v.to_numpy(), 1.5) for _, g in pdf.groupby("track_id")])
    np.testing.assert_allclose(got.s, want, atol=1e-12)
    assert envelope.gaussian_smooth(df, sigma=0.0).filter("s <> v").count() == 0


@pytest.mark.parametrize("size", [256, 8192])
def test_one_pole(spark, size):
    df, pdf = series(spark, [1, 2, 900])
    got = collect(signal.one_pole(df.withColumnRenamed("frame_idx", "idx"), ratio=0.5, size=size), "idx", "v")
    want = []
    for _, g in pdf.groupby("track_id"):
        y = g.v.to_numpy().copy()
        for i in range(1, len(y) - 1):
            y[i] = y[i] * 0.25 + y[i - 1] * 0.75
        want.append(y)
    np.testing.assert_allclose(got.v, np.concatenate(want), atol=1e-12)


@pytest.mark.parametrize("out_rate", [100, 200, 331])
def test_resample(spark, out_rate):
    df, pdf = series(spark, [1, 50])
    got = collect(signal.resample_linear(df.withColumnRenamed("frame_idx", "idx"), in_rate=200, out_rate=out_rate, size=8), "idx", "v")
    ratio, want = out_rate / 200, []
    for _, g in pdf.groupby("track_id"):
        x = g.v.to_numpy()
        for i in range(int(len(x) * ratio)):
            j = int(i / ratio)
            f = i / ratio - j
            want.append(x[j] * (1 - f) + x[min(j + 1, len(x) - 1)] * f)
    np.testing.assert_allclose(got.v, want, atol=1e-12)


@pytest.mark.parametrize("per_block", [1, 3, 512])
def test_stft_blocks(spark, per_block):
    df, pdf = series(spark, [10, 16, 61])
    mags = signal.stft(df.withColumnRenamed("frame_idx", "idx"), length=16, hop=5, per_block=per_block)
    got = mags.toPandas().sort_values(["track_id", "frame_idx"])
    want = []
    for _, g in pdf.groupby("track_id"):
        x = g.v.to_numpy()
        want += [np.abs(np.fft.rfft(x[i : i + 16] * signal.hann_weights(16))) for i in range(0, len(x) - 15, 5)]
    assert len(got) == len(want)
    np.testing.assert_allclose(np.stack(got.mag.to_numpy()), np.stack(want), atol=1e-9)


def test_odd_frame_length_is_padded(spark):
    frames = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0, 4.0, 5.0])], "track_id string, frame_idx long, x array<double>")
    mag = signal.spectrum(frames).first().mag
    x = np.arange(1.0, 6.0) * signal.hann_weights(5)
    np.testing.assert_allclose(mag, np.abs(np.fft.rfft(x, n=8))[:3], atol=1e-12)
