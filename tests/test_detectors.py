"""Detectors on synthetic signals with known beats, and the checks on their output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import envelope, grid, quality, score, segments, signal, tempo
from pulsegrid.plans import detect


def samples(spark, **series):
    parts = [pd.DataFrame({"track_id": k, "idx": np.arange(len(v)), "v": v.astype(float)}) for k, v in series.items()]
    return spark.createDataFrame(pd.concat(parts))


def click_track(rate=22_050, seconds=2.0, at=(0.5, 1.0, 1.5)):
    s = np.zeros(int(rate * seconds))
    s[[int(t * rate) for t in at]] = 1.0
    for i in range(1, len(s)):
        s[i] += 0.5 * s[i - 1]
    return s


def tone_with_clicks(rate=44_100, seconds=5.0):
    t = np.arange(int(rate * seconds)) / rate
    return 0.3 * np.sin(2 * np.pi * 440 * t) + np.where(np.fmod(t, 0.5) < 0.01, 0.7, 0.0)


def test_flux_finds_each_click_and_ignores_silence(spark):
    s = samples(spark, clicks=click_track(), silence=np.zeros(22_050))
    beats = detect.flux_beats(s, rate=22_050, window=1024, hop=256, sigma=1.5, factor=1.2).cache()
    got = [r.t for r in beats.filter("track_id = 'clicks'").orderBy("t").collect()]
    assert len(got) == 3
    assert all(abs(a - b) <= 0.05 for a, b in zip(got, (0.5, 1.0, 1.5)))
    assert quality.silent_tracks_with_beats(s, beats).count() == 0
    assert quality.not_ascending(beats).count() == 0


def test_onset_tempo_of_a_120_bpm_track(spark):
    s = samples(spark, tone=tone_with_clicks())
    beats = detect.onset_beats(s, in_rate=44_100).cache()
    out = detect.onset_tempo(beats)
    assert quality.bpm_outside(out).count() == 0
    assert out.first().n_beats >= 8
    filled = detect.onset_beats(s, in_rate=44_100, fill="seconds")
    assert filled.count() >= beats.count()


def test_energy_tempo_and_status(spark):
    rate = 1000
    s = np.zeros(10_000)
    s[300::500] = 1.0
    for i in range(1, len(s)):
        s[i] += 0.9 * s[i - 1]
    out = detect.energy_tempo(samples(spark, pulse=s, silence=np.zeros(2000)), rate=rate).toPandas().set_index("track_id")
    assert 110 <= out.bpm["pulse"] <= 130
    assert out.n_beats["silence"] == 0 and out.bpm["silence"] == 0.0
    assert quality.analysis_status(spark.createDataFrame([(0.0,), (None,), (2.0,)], "duration double")).filter("status = 'failed'").count() == 2


def test_fill_gaps_in_seconds(spark):
    t = [1.0, 1.5, 2.0, 2.5, 4.0, 4.5]
    beats = spark.createDataFrame(pd.DataFrame({"track_id": "a", "beat_idx": range(len(t)), "t": t}))
    lasting = spark.createDataFrame([("a", 6.0)], "track_id string, duration double")
    got = sorted(r.t for r in grid.fill_gaps(beats, lasting).collect())
    np.testing.assert_allclose(got, [0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5], atol=1e-9)
    assert grid.fill_gaps(beats.filter("beat_idx < 3"), lasting).count() == 3


def test_long_grid_counts(spark):
    anchors = spark.createDataFrame([("a", 0.25, 120.0, 7000.0), ("b", 9.0, 60.0, 4.0), ("c", 0.0, 400.0, 9.0)], "track_id string, first_beat double, bpm double, duration double")
    even = grid.even_grid(anchors).groupBy("track_id").count().toPandas().set_index("track_id")["count"]
    assert even.to_dict() == {"a": 14_000, "c": 45}  # b starts after its end, c is kept at 300 BPM
    re = grid.regrid(anchors).groupBy("track_id").count().toPandas().set_index("track_id")["count"]
    assert re.to_dict() == {"a": 14_000, "b": 4}


def test_octave_fold_matches_the_loops(spark):
    bpms = [0.0, 1.0, 34.9, 35.0, 69.9, 70.0, 90.0, 180.0, 180.1, 360.0, 361.0, 4000.0]

    def loop(b):
        while b > 180:
            b /= 2
        while 0 < b < 70:
            b *= 2
        return b

    df = spark.createDataFrame([(b,) for b in bpms], "bpm double")
    got = [r[0] for r in df.select(tempo.octave_fold(F.col("bpm"))).collect()]
    np.testing.assert_allclose(got, [loop(b) for b in bpms], rtol=1e-12)


def test_separation_adds_up_and_block_size_does_not_matter(spark):
    rng = np.random.default_rng(1)
    s = samples(spark, a=rng.normal(0, 0.1, 100))
    cut = segments.overlap_segments(s, length=16)
    back = segments.overlap_add(cut, length=16, symmetric=True).orderBy("idx").toPandas()
    np.testing.assert_allclose(back.v, s.orderBy("idx").toPandas().v, atol=1e-12)
    mel = spark.createDataFrame([("a", i, [float(x) for x in rng.normal(size=3)]) for i in range(50)], "track_id string, frame_idx long, mel array<double>")
    small = score.score_frames(mel, per_block=3).orderBy("frame_idx").toPandas()
    large = score.score_frames(mel).orderBy("frame_idx").toPandas()
    np.testing.assert_allclose(small.v, large.v)


def test_model_chain_runs_and_peaks_keep_their_distance(spark):
    s = samples(spark, clicks=click_track(rate=8000, seconds=4.0, at=(0.5, 1.0, 1.5, 2.0, 2.5, 3.0)))
    beats = detect.model_beats(s, in_rate=8000, rate=4000, hop=80, n_mels=20, n_fft=256, fmax=2000.0, threshold=0.5)
    t = np.sort(beats.toPandas().t)
    assert len(t) == 6 and (np.diff(t) >= 0.27).all()


def test_short_track_gives_one_mel_frame(spark):
    s = samples(spark, short=np.ones(10))
    mel = detect.log_mel(s, in_rate=4000, rate=4000, n_mels=4, n_fft=64, hop=16, fmax=2000.0)
    assert mel.count() == 1
    assert envelope.local_maximum(mel.select("track_id", "frame_idx", F.lit(1.0).alias("v"))).filter("is_peak").count() == 0


def test_mel_rows_are_normalised(spark):
    bank = signal.mel_filterbank(spark, rate=22_050, n_mels=81, n_fft=2048, fmin=30.0, fmax=11_000.0)
    sums = bank.groupBy("mel").agg(F.sum("weight").alias("s")).toPandas().s
    assert len(sums) == 81
    assert all(abs(x - 1) < 1e-9 or x == 0 for x in sums)
