"""Queries for the B family: signal preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.registry import query
from pulsegrid.catalog.views import r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import signal
from pulsegrid.sources import fixtures as fx

LENGTH, HOP = 32, 8  # frame and hop used on the 200 Hz stand-in signal


def v(df):
    return df.select("track_id", "idx", rnd("v").alias("v"))


@query("b1_mono_to_stereo", with_views("samples", f"SELECT track_id, idx * 2 + ch AS idx, {r('v')} AS v FROM samples, (VALUES (0), (1)) c(ch)"))
def b1(spark, sf):
    return v(signal.mono_to_stereo(fx.samples(spark, sf)))


@query("b2_stereo_to_mono", with_views("samples", f"SELECT track_id, idx // 2 AS idx, {r('sum(v) * 0.5')} AS v FROM samples GROUP BY 1, 2 HAVING count(*) = 2"))
def b2(spark, sf):
    return v(signal.stereo_to_mono(fx.samples(spark, sf)))


@query("b2_stereo_to_mono_strict", with_views("samples", f"SELECT track_id, idx // 2 AS idx, {r('sum(v) * 0.5')} AS v FROM samples "
       "WHERE track_id IN (SELECT track_id FROM samples GROUP BY 1 HAVING count(*) % 2 = 0) GROUP BY 1, 2"))
def b2_strict(spark, sf):
    return v(signal.stereo_to_mono(fx.samples(spark, sf), odd="empty"))


@query("b3_downmix", with_views("samples", f"SELECT track_id, (idx // 3) * 2 + ch AS idx, {r('sum(v) / 3')} AS v FROM samples, (VALUES (0), (1)) c(ch) GROUP BY track_id, idx // 3, ch HAVING count(*) = 3"))
def b3(spark, sf):
    return v(signal.downmix(fx.samples(spark, sf), channels=3))


RESAMPLE = """o AS (SELECT track_id, unnest(range(CAST(floor(n * {ratio}) AS BIGINT))) AS i FROM (SELECT track_id, count(*) AS n FROM {src} GROUP BY 1)),
res AS (SELECT o.track_id, o.i AS idx, CASE WHEN b.v IS NULL THEN a.v ELSE a.v * (1.0 - (o.i / {ratio} - a.idx)) + b.v * (o.i / {ratio} - a.idx) END AS v
FROM o JOIN {src} a ON a.track_id = o.track_id AND a.idx = CAST(floor(o.i / {ratio}) AS BIGINT)
LEFT JOIN {src} b ON b.track_id = o.track_id AND b.idx = a.idx + 1)"""


@query("b4_resample_up", with_views("samples", "WITH " + RESAMPLE.format(ratio="CAST(1.6 AS DOUBLE)", src="samples") + f" SELECT track_id, idx, {r('v')} AS v FROM res"))
def b4(spark, sf):
    return v(signal.resample_linear(fx.samples(spark, sf), in_rate=200, out_rate=320))


@query("b4_resample_down", with_views("samples", "WITH " + RESAMPLE.format(ratio="(CAST(150 AS DOUBLE) / 200)", src="samples") + f" SELECT track_id, idx, {r('v')} AS v FROM res"))
def b4_down(spark, sf):
    return v(signal.resample_linear(fx.samples(spark, sf), in_rate=200, out_rate=150))


FIR = """raw AS (SELECT k, (CASE WHEN k = 0 THEN CAST(0.5 AS DOUBLE) ELSE sin(pi() * 0.5 * k) / (pi() * k) END) *
(0.42 - 0.5 * cos(2 * pi() * (k + 15) / 30) + 0.08 * cos(4 * pi() * (k + 15) / 30)) AS w FROM (SELECT unnest(range(-15, 16)) AS k)),
taps AS (SELECT k, w / (SELECT sum(w) FROM raw) AS w FROM raw),
fir AS (SELECT s.track_id, s.idx - k AS idx, sum(v * w) AS v FROM samples s, taps JOIN (SELECT track_id, max(idx) AS last FROM samples GROUP BY 1) m ON true
WHERE m.track_id = s.track_id AND s.idx - k BETWEEN 0 AND last GROUP BY 1, 2)"""


@query("b5_antialias_resample", with_views("samples", "WITH " + FIR + ",\n" + RESAMPLE.format(ratio="CAST(0.5 AS DOUBLE)", src="fir") + f" SELECT track_id, idx, {r('v')} AS v FROM res"))
def b5(spark, sf):
    return v(signal.resample_antialias(fx.samples(spark, sf), in_rate=200, out_rate=100))


@query("b6_one_pole", with_views("samples", f"""WITH y(track_id, idx, v) AS (SELECT track_id, idx, v FROM samples WHERE idx = 0
UNION ALL SELECT s.track_id, s.idx, CASE WHEN s.idx = m.last THEN s.v ELSE s.v * CAST(0.25 AS DOUBLE) + y.v * CAST(0.75 AS DOUBLE) END
FROM y JOIN samples s ON s.track_id = y.track_id AND s.idx = y.idx + 1 JOIN (SELECT track_id, max(idx) AS last FROM samples GROUP BY 1) m ON m.track_id = s.track_id)
SELECT track_id, idx, {r('v')} AS v FROM y""", recursive=True))
def b6(spark, sf):
    return v(signal.one_pole(fx.samples(spark, sf), ratio=0.5))


FRAMED = """sn AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM samples),
framed AS (SELECT track_id, frame_idx, idx - frame_idx * {h} AS pos, v, n FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - {l} + 1) / {h}.0) AS BIGINT)), idx // {h} + 1)) AS frame_idx FROM sn)
WHERE {keep})"""


def framed(length, hop, rule):
    keep = {"strict": f"frame_idx * {hop} + {length} < n", "full": f"frame_idx * {hop} + {length} <= n", "pad": f"(frame_idx * {hop} + {length} <= n OR frame_idx = 0)"}[rule]
    return FRAMED.format(l=length, h=hop, keep=keep)


@query("b7_framing", with_views("samples", "WITH " + framed(32, 8, "full") + f" SELECT track_id, frame_idx, pos, {r('v')} AS v FROM framed"))
def b7(spark, sf):
    return signal.frame_samples(fx.samples(spark, sf), length=LENGTH, hop=HOP).select("track_id", "frame_idx", "pos", rnd("v").alias("v"))


@query("b7_framing_strict", with_views("samples", "WITH " + framed(6, 3, "strict") + " SELECT track_id, count(DISTINCT frame_idx) AS n_frames, count(*) AS n FROM framed GROUP BY 1"))
def b7_strict(spark, sf):
    f = signal.frame_samples(fx.samples(spark, sf), length=6, hop=3, rule="strict")
    return f.groupBy("track_id", "frame_idx").agg(F.count(F.lit(1)).alias("c")).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("c").alias("n"))


FX = "fx AS (SELECT track_id, frame_idx, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS n FROM frames)"
HANN = "CAST(0.5 AS DOUBLE) * (1 - cos(2 * pi() * n / 63))"


@query("b8_hann_window", with_views("frames", f"WITH {FX} SELECT track_id, frame_idx, CAST(n AS BIGINT) AS pos, {r('v * ' + HANN)} AS v FROM fx"))
def b8(spark, sf):
    rows = fx.frames(spark, sf).select("track_id", "frame_idx", F.posexplode("x").alias("pos", "v"))
    return rows.select("track_id", "frame_idx", F.col("pos").cast("long").alias("pos"), rnd(F.col("v") * signal.hann(F.col("pos"), 64)).alias("v"))


@query("b9_zero_pad", "SELECT doc_id, CAST(pow(2, ceil(log2(greatest(len(string_split(text, ' ')), 1)))) AS BIGINT) AS padded, CAST(len(string_split(text, ' ')) AS BIGINT) AS n, CAST(length(text) - len(string_split(text, ' ')) + 1 AS DOUBLE) AS total, CAST(length(string_split(text, ' ')[-1]) AS DOUBLE) AS last FROM documents")
def b9(spark, sf):
    words = fx.table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("double")).alias("x"))
    padded = words.withColumn("p", signal.zero_pad(F.col("x")))
    total = F.aggregate("p", F.lit(0.0), lambda acc, v: acc + v)
    return padded.select("doc_id", F.size("p").cast("long").alias("padded"), F.size("x").cast("long").alias("n"), total.alias("total"), F.element_at("p", F.size("x")).alias("last"))


def spec(expr, bins="33", size=64, src="fx", window=HANN):
    c = f"sum(v * ({window}) * cos(2 * pi() * n * bin / {size}))"
    s = f"sum(v * ({window}) * sin(2 * pi() * n * bin / {size}))"
    return f"spec AS (SELECT track_id, frame_idx, bin, {expr.format(p=f'({c} * {c} + {s} * {s})')} AS mag FROM {src}, (SELECT unnest(range({bins})) AS bin) GROUP BY 1, 2, 3)"


@query("b10_magnitude_spectrum", with_views("frames", f"WITH {FX}, {spec('sqrt({p})')} SELECT track_id, frame_idx, bin, {r('mag')} AS mag FROM spec"))
def b10(spark, sf):
    mags = signal.spectrum(fx.frames(spark, sf))
    return mags.select("track_id", "frame_idx", F.posexplode("mag").alias("bin", "mag")).select("track_id", "frame_idx", F.col("bin").cast("long").alias("bin"), rnd("mag").alias("mag"))


@query("b10_power_spectrum_of_signal", with_views("samples", "WITH " + framed(32, 8, "full") + ", fr AS (SELECT track_id, frame_idx, pos AS n, v FROM framed), "
       + spec("{p}", "17", 32, "fr", "CAST(0.5 AS DOUBLE) * (1 - cos(2 * pi() * n / 31))") + f" SELECT track_id, frame_idx, bin, {r('mag')} AS mag FROM spec"))
def b10_power(spark, sf):
    mags = signal.stft(fx.samples(spark, sf), length=LENGTH, hop=HOP, kind="power")
    return mags.select("track_id", "frame_idx", F.posexplode("mag").alias("bin", "mag")).select("track_id", "frame_idx", F.col("bin").cast("long").alias("bin"), rnd("mag").alias("mag"))


def mel_sql(rate, n_mels, n_fft, fmin, fmax):
    """Triangular bank of ``signal.mel_filterbank`` as table ``bank(mel, bin, weight)``."""
    return f"""edges AS (SELECT m, CAST(floor({n_fft + 1} * (700.0 * (pow(10, (lo + m * (hi - lo) / {n_mels + 1}) / 2595.0) - 1)) / {float(rate)}) AS BIGINT) AS b
FROM (SELECT unnest(range({n_mels + 2})) AS m, 2595.0 * log10(1 + {fmin} / 700.0) AS lo, 2595.0 * log10(1 + {min(fmax, rate / 2.0)} / 700.0) AS hi)),
tri AS (SELECT e.m AS mel, bin, CASE WHEN bin >= e.b AND bin < f.b THEN CAST(bin - e.b AS DOUBLE) / (f.b - e.b) WHEN bin >= f.b AND bin < g.b THEN CAST(g.b - bin AS DOUBLE) / (g.b - f.b) ELSE 0 END AS w
FROM edges e JOIN edges f ON f.m = e.m + 1 JOIN edges g ON g.m = e.m + 2, (SELECT unnest(range({n_fft // 2 + 1})) AS bin)),
bank AS (SELECT mel, bin, CASE WHEN sum(w) OVER (PARTITION BY mel) > 0 THEN w / sum(w) OVER (PARTITION BY mel) ELSE 0.0 END AS weight FROM tri)"""


MEL_ARGS = dict(rate=4000, n_mels=8, n_fft=64, fmin=30.0, fmax=11_000.0)
MEL = mel_sql(**MEL_ARGS)


@query("b11_mel_filterbank_energy", with_views("frames", f"WITH {FX}, {spec('{p}')}, {MEL} SELECT mel, bin, {r('weight * avg(mag)')} AS v FROM bank JOIN spec USING (bin) GROUP BY mel, bin, weight"))
def b11(spark, sf):
    power = signal.spectrum(fx.frames(spark, sf), kind="power")
    mean = power.select(F.posexplode("mag").alias("bin", "p")).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.avg("p").alias("p"))
    return signal.mel_filterbank(spark, **MEL_ARGS).join(mean, "bin").select("mel", "bin", rnd(F.col("weight") * F.col("p")).alias("v"))


@query("b12_log_mel", with_views("frames", f"WITH {FX}, {spec('{p}')}, {MEL} SELECT track_id, frame_idx, mel, {r('ln(greatest(sum(mag * weight), 1e-10))', 5)} AS v FROM spec JOIN bank USING (bin) GROUP BY 1, 2, 3"))
def b12(spark, sf):
    power = signal.spectrum(fx.frames(spark, sf), kind="power")
    mel = signal.mel_project(power, signal.mel_filterbank(spark, **MEL_ARGS), n_mels=8)
    return mel.select("track_id", "frame_idx", "mel", rnd("v", 5).alias("v"))


BANDS = """bands AS (SELECT track_id, frame_idx, sum(mag) FILTER (bin BETWEEN 0 AND 2) / 3 AS bass, sum(mag) FILTER (bin BETWEEN 3 AND 21) / 19 AS mid,
sum(mag) FILTER (bin BETWEEN 22 AND 31) / 10 AS high FROM spec GROUP BY 1, 2)"""
BAND_RATE = 6000.0  # 93.75 Hz per bin: 20, 200 and 2000 Hz fall on bins 0, 2 and 21


def bands(spark, sf):
    return signal.band_energy(signal.spectrum(fx.frames(spark, sf)), rate=BAND_RATE, n_fft=64)


@query("b13_band_energy", with_views("frames", f"WITH {FX}, {spec('sqrt({p})')}, {BANDS} SELECT track_id, frame_idx, {r('bass')} AS bass, {r('mid')} AS mid, {r('high')} AS high FROM bands"))
def b13(spark, sf):
    return bands(spark, sf).select("track_id", "frame_idx", *[rnd(c).alias(c) for c in ("bass", "mid", "high")])


@query("b14_time_band_energy", with_views("samples", "WITH d AS (SELECT track_id, idx, v, abs(v - lag(v) OVER (PARTITION BY track_id ORDER BY idx)) AS d, count(*) OVER (PARTITION BY track_id) AS n FROM samples), "
       "fr AS (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - 31) / 8.0) AS BIGINT)), idx // 8 + 1)) AS frame_idx FROM d), "
       "b AS (SELECT track_id, frame_idx, sum(abs(v)) / 32 AS bass, sum(CASE WHEN idx = frame_idx * 8 THEN abs(v) ELSE d END) / 32 AS high FROM fr WHERE frame_idx * 8 + 32 <= n GROUP BY 1, 2) "
       f"SELECT track_id, frame_idx, {r('bass')} AS bass, {r('high')} AS high, {r('greatest(0, bass - high * 0.5)')} AS mid FROM b"))
def b14(spark, sf):
    b = signal.time_band_energy(fx.samples(spark, sf), length=LENGTH, hop=HOP)
    return b.select("track_id", "frame_idx", *[rnd(c).alias(c) for c in ("bass", "high", "mid")])


ENERGY = framed(6, 3, "strict") + ", energy AS (SELECT track_id, frame_idx, sum(v * v) / 6.0 AS v FROM framed GROUP BY 1, 2)"


@query("b15_frame_energy", with_views("samples", f"WITH {ENERGY} SELECT track_id, frame_idx, {r('v', 8)} AS v FROM energy"))
def b15(spark, sf):
    return signal.frame_energy(fx.samples(spark, sf), length=6, hop=3).select("track_id", "frame_idx", rnd("v", 8).alias("v"))


@query("b16_waveform_peaks", with_views("samples", f"SELECT track_id, idx // k AS bucket, {r('max(abs(v))')} AS peak FROM (SELECT *, greatest(count(*) OVER (PARTITION BY track_id) // 500, 1) AS k FROM samples) GROUP BY 1, 2"))
def b16(spark, sf):
    return signal.waveform_peaks(fx.samples(spark, sf), buckets=500).select("track_id", "bucket", rnd("peak").alias("peak"))


@query("b17_band_peaks", with_views("frames", f"WITH {FX}, {spec('sqrt({p})')}, {BANDS}, k AS (SELECT *, greatest(count(*) OVER (PARTITION BY track_id) // 20, 1) AS k, max(bass) OVER (PARTITION BY track_id) AS xb, "
       "max(mid) OVER (PARTITION BY track_id) AS xm, max(high) OVER (PARTITION BY track_id) AS xh FROM bands) "
       f"SELECT track_id, frame_idx // k AS bucket, {r('max(bass / xb)')} AS bass, {r('max(mid / xm)')} AS mid, {r('max(high / xh)')} AS high FROM k GROUP BY 1, 2"))
def b17(spark, sf):
    return signal.band_peaks(bands(spark, sf), buckets=20).select("track_id", "bucket", *[rnd(c).alias(c) for c in ("bass", "mid", "high")])


@query("b18_signal_stats", with_views("samples", f"SELECT track_id, {r('min(v)')} AS min_v, {r('max(v)')} AS max_v, {r('avg(abs(v))')} AS mean_abs FROM samples GROUP BY 1"))
def b18(spark, sf):
    return signal.signal_stats(fx.samples(spark, sf)).select("track_id", *[rnd(c).alias(c) for c in ("min_v", "max_v", "mean_abs")])


@query("b19_peak_limit", with_views("samples", f"SELECT track_id, idx, {r('CASE WHEN m > 0.99 THEN w * (CAST(0.99 AS DOUBLE) / m) ELSE w END')} AS v FROM "
       "(SELECT *, max(abs(w)) OVER (PARTITION BY track_id) AS m FROM (SELECT track_id, idx, v * 20 AS w FROM samples))"))
def b19(spark, sf):
    return v(signal.peak_limit(fx.samples(spark, sf).withColumn("v", F.col("v") * 20)))


@query("b20_stem_mix", "WITH s AS (SELECT event_type AS track_id, user_id % 4 AS stem, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS idx, (value - 50) / 500 AS v FROM events), "
       f"n AS (SELECT track_id, max(idx) AS last FROM s WHERE stem = 2 GROUP BY 1) SELECT track_id, idx, {r('sum(v)')} AS v FROM s JOIN n USING (track_id) WHERE idx <= last GROUP BY 1, 2")
def b20(spark, sf):
    return v(signal.stem_mix(fx.stem_samples(spark, sf), first=2))


@query("b21_band_effects", with_views("frames", f"WITH {FX}, {spec('sqrt({p})')}, {BANDS} SELECT track_id, frame_idx, {r('least(bass, 1.0)')} AS zoom, {r('least(mid, 1.0)')} AS saturation, {r('least(high, 1.0)')} AS brightness FROM bands"))
def b21(spark, sf):
    return signal.bands_to_effects(bands(spark, sf)).select("track_id", "frame_idx", *[rnd(c).alias(c) for c in ("zoom", "saturation", "brightness")])
