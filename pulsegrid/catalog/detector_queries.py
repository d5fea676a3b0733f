"""Queries for the I, J, K and L families: scoring, detectors, streams, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.envelope_queries import FLUX, FRAME_FLUX, IQR, ONSET_ENV, P, RESCUE, RULES, SMOOTH, W, gauss_sql, greedy_sql
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.signal_queries import ENERGY, FIR, FX, MEL, MEL_ARGS, RESAMPLE, framed, mel_sql, spec
from pulsegrid.catalog.tempo_queries import CANDIDATES, DOWN, FOLD, best_sql
from pulsegrid.catalog.views import VIEWS, r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import envelope, quality, score, segments, signal, tempo
from pulsegrid.plans import detect
from pulsegrid.session import new_path, stage
from pulsegrid.sources import fixtures as fx
from pulsegrid.streaming import chunks as stream

HANN32 = "CAST(0.5 AS DOUBLE) * (1 - cos(2 * pi() * n / 31))"


def timed(df, *extra):
    return df.select(*extra, "beat_idx", rnd("t").alias("t"))


# ---- I --------------------------------------------------------------------------------------

MEL_FLUX = (
    f"{FX}, {spec('{p}')}, {MEL}, ml AS (SELECT track_id, frame_idx, mel AS bin, ln(greatest(sum(mag * weight), 1e-10)) AS mag FROM spec JOIN bank USING (bin) GROUP BY 1, 2, 3), "
    + FLUX.replace("FROM spec", "FROM ml")
)


def mel_rows(spark, sf):
    power = signal.spectrum(fx.frames(spark, sf), kind="power")
    lines = signal.mel_project(power, signal.mel_filterbank(spark, **MEL_ARGS), n_mels=8)
    packed = lines.groupBy("track_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("mel", "v"))).alias("m"))
    return packed.select("track_id", "frame_idx", F.transform("m", lambda s: s["v"]).alias("mel"))


@query("i1_score_frames", with_views("frames", f"WITH {MEL_FLUX} SELECT track_id, frame_idx, {r('v', 5)} AS v FROM flux"))
def i1(spark, sf):
    return score.score_frames(mel_rows(spark, sf)).select("track_id", "frame_idx", rnd("v", 5).alias("v"))


def peaks_sql(src, level, rule, gap, rate, start=None):
    return (
        f"pm AS (SELECT *, lag(v) OVER {W}) AS l, lead(v) OVER {W}) AS r FROM {src}), cand AS (SELECT track_id, frame_idx, frame_idx / CAST({rate} AS DOUBLE) AS pos FROM pm WHERE {RULES[rule]} AND v > {level}), "
        + greedy_sql("cand", "pos", f"CAST({gap} AS DOUBLE)")
    )


NORM_ACT = f"act AS (SELECT track_id, frame_idx, v / max(v) OVER {P} AS v FROM flux)"


def activation(spark, sf):
    flux = envelope.spectral_flux(signal.spectrum(fx.frames(spark, sf)))
    return stage(envelope.max_normalise(flux), "activation")


def _i2(kind, gap, level):
    sql = with_views("frames", f"WITH {FRAME_FLUX}, {NORM_ACT}, {peaks_sql('act', level, 'flat_left', gap, 10)} SELECT track_id, frame_idx, {r('frame_idx / 10.0')} AS t FROM kept", recursive=True)

    @query(f"i2_{kind}_peaks", sql)
    def run(spark, sf):
        return score.activation_peaks(activation(spark, sf), kind, frame_rate=10.0, threshold=level).select("track_id", "frame_idx", rnd("t").alias("t"))


for _kind, _gap, _level in (("beat", 0.27, 0.3), ("downbeat", 0.54, 0.3), ("segment", 1.0, 0.5)):
    _i2(_kind, _gap, _level)

LABEL_LIST = "['intro','verse','pre-chorus','chorus','post-chorus','bridge','outro','instrumental','solo','silence']"


@query("i2_labelled_segments", with_views("frames", f"WITH {FRAME_FLUX}, {NORM_ACT}, {peaks_sql('act', 0.5, 'flat_left', 1.0, 10)}, "
       "sg AS (SELECT track_id, frame_idx, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS seg_idx, lead(frame_idx) OVER (PARTITION BY track_id ORDER BY frame_idx) AS nf FROM kept), "
       "n AS (SELECT track_id, max(frame_idx) + 1 AS n FROM frames GROUP BY 1), "
       "h AS (SELECT s.*, n, x[1:10] AS h FROM sg s JOIN n USING (track_id) JOIN frames f ON f.track_id = s.track_id AND f.frame_idx = CAST(floor(s.frame_idx / CAST(10 AS DOUBLE) * 10) AS BIGINT)) "
       f"SELECT track_id, seg_idx, {r('frame_idx / 10.0')} AS start_s, {r('coalesce(nf, n) / 10.0')} AS end_s, {LABEL_LIST}[list_position(h, list_max(h))] AS label, {r('1 / (1 + exp(-list_max(h)))')} AS confidence FROM h", recursive=True))
def i2_labels(spark, sf):
    act = activation(spark, sf)
    lasting = act.groupBy("track_id").agg(((F.max("frame_idx") + 1) / 10.0).alias("duration"))
    out = score.labelled_segments(act, fx.frames(spark, sf), lasting, frame_rate=10.0)
    return out.select("track_id", "seg_idx", "label", *[rnd(c).alias(c) for c in ("start_s", "end_s", "confidence")])


def separation_sql(length):
    """Four spectral bands of each padded segment by discrete Fourier sums, overlap-added and limited: ``sep``."""
    hop, fade, half = length - length // 4, length // 4, length // 2
    edges = [(half + 1) * i // 4 for i in range(1, 4)]
    stem = f"CASE WHEN k < {edges[0]} THEN 'drums' WHEN k < {edges[1]} THEN 'bass' WHEN k < {edges[2]} THEN 'other' ELSE 'vocals' END"
    angle = f"2 * pi() * k * pos / {length}"
    return (
        f"sg AS (SELECT track_id, seg, idx - seg * {hop} AS pos, v FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - {length - 1}) / {hop}.0) AS BIGINT)), idx // {hop} + 1)) AS seg FROM raw)), "
        f"ft AS (SELECT track_id, seg, k, sum(v * cos({angle})) AS re, -sum(v * sin({angle})) AS im FROM sg, (SELECT unnest(range({half + 1})) AS k) GROUP BY 1, 2, 3), "
        f"st AS (SELECT f.track_id, f.seg, {stem} AS stem, pos, sum(CASE WHEN k IN (0, {half}) THEN 1 ELSE 2 END * (re * cos({angle}) - im * sin({angle}))) / {length} AS v FROM ft f JOIN sg USING (track_id, seg) GROUP BY 1, 2, 3, 4), "
        "zl AS (SELECT *, max(pos) OVER (PARTITION BY track_id, stem, seg) + 1 AS len FROM st), "
        f"wt AS (SELECT *, seg * {hop} + pos AS idx, CASE WHEN seg > 0 AND pos < {fade} THEN pos / {fade}.0 * CASE WHEN len >= {fade} AND pos >= len - {fade} THEN (len - 1 - pos) / {fade}.0 ELSE 1.0 END END AS wt FROM zl), "
        "oa AS (SELECT track_id, stem, idx, CASE WHEN arg_max(coalesce(wt, -1), seg) < 0 THEN arg_max(v, seg) ELSE arg_min(v, seg) * (1 - arg_max(wt, seg)) + arg_max(v, seg) * arg_max(wt, seg) END AS v FROM wt GROUP BY 1, 2, 3), "
        "sep AS (SELECT track_id, stem, idx, CASE WHEN m > 0.99 THEN v * (0.99 / m) ELSE v END AS v FROM (SELECT *, max(abs(v)) OVER (PARTITION BY track_id, stem) AS m FROM oa))"
    )


@query("i3_separation", f"WITH raw AS ({VIEWS['samples']}), {separation_sql(256)} SELECT track_id, stem, idx, {r('v')} AS v FROM sep")
def i3(spark, sf):
    return score.separate(fx.samples(spark, sf), length=256).select("track_id", "stem", "idx", rnd("v").alias("v"))


MIX = (
    "WITH sg AS (SELECT track_id, seg, idx - seg * 192 AS pos, v FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - 255) / 192.0) AS BIGINT)), idx // 192 + 1)) AS seg FROM samples)), "
    "z AS (SELECT *, max(pos) OVER (PARTITION BY track_id, seg) + 1 AS len FROM sg), "
    "w AS (SELECT *, seg * 192 + pos AS idx, CASE WHEN seg > 0 AND pos < 64 THEN pos / 64.0 * CASE WHEN len >= 64 AND pos >= len - 64 THEN (len - 1 - pos) / 64.0 ELSE 1.0 END END AS wt FROM z), "
    "mx AS (SELECT track_id, idx, CASE WHEN arg_max(coalesce(wt, -1), seg) < 0 THEN arg_max(v, seg) ELSE arg_min(v, seg) * (1 - arg_max(wt, seg)) + arg_max(v, seg) * arg_max(wt, seg) END AS v FROM w GROUP BY 1, 2) "
)


@query("i3_separation_mix", with_views("samples", MIX + f"SELECT track_id, count(*) AS n, {r('sum(abs(v))', 5)} AS level FROM mx GROUP BY 1"))
def i3_mix(spark, sf):
    """The four bands add up to the blended segments of the signal itself."""
    mix = signal.stem_mix(score.separate(fx.samples(spark, sf), length=256, limit=False))
    return mix.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(F.abs("v")), 5).alias("level"))


STEREO = (
    f"base AS ({VIEWS['samples']}), duo AS (SELECT track_id || '/' || ch AS track_id, idx, CASE WHEN ch = 0 THEN v * 12 ELSE v * 12 * (idx % 7 - 3) / CAST(3 AS DOUBLE) END AS v FROM base, (VALUES (0), (1)) c(ch)), "
)
POLE = (
    "pole(track_id, idx, v) AS (SELECT track_id, idx, v FROM duo WHERE idx = 0 UNION ALL SELECT s.track_id, s.idx, CASE WHEN s.idx = m.last THEN s.v ELSE s.v * CAST(0.25 AS DOUBLE) + pole.v * CAST(0.75 AS DOUBLE) END "
    "FROM pole JOIN duo s ON s.track_id = pole.track_id AND s.idx = pole.idx + 1 JOIN (SELECT track_id, max(idx) AS last FROM duo GROUP BY 1) m ON m.track_id = s.track_id), "
)


def stereo_separation_sql(length):
    """``sep`` on keys of track and channel, limited by the louder channel."""
    return separation_sql(length).replace("PARTITION BY track_id, stem) AS m", "PARTITION BY split_part(track_id, '/', 1), stem) AS m")


def interleaved(spark, sf):
    """Two channels made of each track."""
    ch = F.explode(F.array(F.lit(0), F.lit(1))).alias("ch")
    v = F.when(F.col("ch") == 0, F.col("v") * 12).otherwise(F.col("v") * 12 * (F.col("idx") % 7 - 3) / F.lit(3.0))
    return fx.samples(spark, sf).select("track_id", "idx", "v", ch).select("track_id", (F.col("idx") * 2 + F.col("ch")).alias("idx"), v.alias("v"))


@query("i3_stereo_separation", f"WITH RECURSIVE {STEREO}{POLE}" + RESAMPLE.format(ratio="(CAST(100 AS DOUBLE) / 200)", src="pole") + f", raw AS (SELECT * FROM res), {stereo_separation_sql(256)} "
       f"SELECT split_part(track_id, '/', 1) AS track_id, CAST(split_part(track_id, '/', 2) AS INTEGER) AS ch, stem, idx, {r('v')} AS v FROM sep")
def i3_stereo(spark, sf):
    """Two channels brought from 200 to 100 values a second behind the one-pole filter, then separated together."""
    stems = score.separate_stereo(interleaved(spark, sf), in_rate=200, model_rate=100, length=256)
    return stems.select("track_id", "ch", "stem", "idx", rnd("v").alias("v"))


def by_stem(sql):
    """The energy detector's SQL with (track, stem) packed into one key."""
    return sql.replace("samples AS (SELECT event_type AS track_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)", "samples AS (SELECT event_type || '/' || (user_id % 4) AS track_id, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id)")


CAND = f"mk AS (SELECT *, lag(s) OVER {W}) AS l, lead(s) OVER {W}) AS r, avg(s) OVER {P} AS thr FROM smooth), cand AS (SELECT track_id, frame_idx, frame_idx AS pos FROM mk WHERE s > l AND s > r AND s > thr)"
J1 = f"{ENERGY}, {SMOOTH}, {CAND}, {greedy_sql('cand', 'pos', 18, 0)}, jb AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS beat_idx, frame_idx * 3 / CAST(200 AS DOUBLE) AS t FROM kept)"


@query("i4_stem_beats", by_stem(with_views("samples", f"WITH {J1} SELECT track_id, beat_idx, {r('t')} AS t FROM jb", recursive=True)))
def i4(spark, sf):
    beats = detect.energy_beats(fx.stem_samples(spark, sf), rate=fx.RATE, keys=["track_id", "stem"])
    return timed(beats, F.concat_ws("/", "track_id", F.col("stem").cast("string")).alias("track_id"))


@query("i5_model_type", "SELECT p_partkey, CASE WHEN p_type <> 'LARGE' THEN p_type WHEN p_name LIKE '%segment%' OR p_partkey % 3 = 0 THEN 'AllInOne' ELSE 'BeatNet' END AS model FROM part")
def i5(spark, sf):
    p = fx.table(spark, sf, "part")
    outputs = F.array(F.lit("beats"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "segment_out").otherwise("labels"))
    declared = F.when(F.col("p_type") == "LARGE", "Custom").otherwise(F.col("p_type"))
    return p.select("p_partkey", score.model_type(outputs, declared).alias("model"))


# ---- J --------------------------------------------------------------------------------------

J1_TEMPO = (
    f"{J1}, iv AS (SELECT * FROM (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS x FROM jb) WHERE x IS NOT NULL), "
    "md AS (SELECT track_id, 60.0 / list_sort(list(x))[count(*) // 2 + 1] AS bpm FROM iv GROUP BY 1), "
    "al AS (SELECT s.track_id, s.duration, coalesce(n, 0) AS n_beats, coalesce(bpm, 0.0) AS bpm FROM (SELECT track_id, count(*) / 200.0 AS duration FROM samples GROUP BY 1) s "
    f"LEFT JOIN (SELECT track_id, count(*) AS n FROM jb GROUP BY 1) c USING (track_id) LEFT JOIN md USING (track_id)), fo AS (SELECT *, {DOWN} AS down FROM al)"
)


@query("j1_energy_detector", with_views("samples", f"WITH {J1_TEMPO} SELECT track_id, {r('duration')} AS duration, n_beats, {r('bpm')} AS raw_bpm, {r(FOLD)} AS bpm FROM fo", recursive=True))
def j1(spark, sf):
    out = detect.energy_tempo(fx.samples(spark, sf), rate=fx.RATE)
    return out.select("track_id", "n_beats", *[rnd(c).alias(c) for c in ("duration", "raw_bpm", "bpm")])


@query("j1_energy_beats", with_views("samples", f"WITH {J1} SELECT track_id, beat_idx, {r('t')} AS t FROM jb", recursive=True))
def j1_beats(spark, sf):
    return timed(detect.energy_beats(fx.samples(spark, sf), rate=fx.RATE), "track_id")


HINT = "CASE length(track_id) % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 120 ELSE 400 END"


@query("j1_energy_hint", with_views("samples", f"WITH {J1}, an AS (SELECT s.track_id, duration, f, CASE WHEN h <= 0 THEN 0 ELSE least(greatest(h, 20), 300) END AS bpm FROM (SELECT track_id, count(*) / CAST(200 AS DOUBLE) AS duration, {HINT} AS h FROM samples GROUP BY 1) s "
       "JOIN (SELECT track_id, min(t) AS f FROM jb GROUP BY 1) USING (track_id)), ev AS (SELECT track_id, f, 60 / CAST(bpm AS DOUBLE) AS step, unnest(range(CAST(ceil((duration - f) / (60 / CAST(bpm AS DOUBLE)) - 1e-9) AS BIGINT))) AS beat_idx FROM an WHERE bpm > 0) "
       f"SELECT track_id, beat_idx, {r('f + beat_idx * step')} AS t FROM ev UNION ALL SELECT track_id, beat_idx, {r('t')} AS t FROM jb SEMI JOIN (SELECT track_id FROM an WHERE bpm = 0) z USING (track_id)", recursive=True))
def j1_hint(spark, sf):
    kind = F.length("track_id") % 4
    hint = F.when(kind == 0, 0).when(kind == 1, 10).when(kind == 2, 120).otherwise(400)
    return timed(detect.hinted_beats(fx.samples(spark, sf), rate=fx.RATE, hint=hint), "track_id")


J2 = (
    framed(32, 8, "full") + ", fr AS (SELECT track_id, frame_idx, pos AS n, v FROM framed), " + spec("sqrt({p})", "17", 32, "fr", HANN32) + f", {FLUX}, "
    f"zs AS (SELECT track_id, frame_idx, (v - avg(v) OVER {P}) / (coalesce(stddev_samp(v) OVER {P}, 0) + 1e-9) AS v FROM flux), {gauss_sql('CAST(1.5 AS DOUBLE)', 5, 'zs', 'gs')}, "
    f"th AS (SELECT *, lag(s) OVER {W}) AS l, lead(s) OVER {W}) AS r, greatest(avg(greatest(s, 0)) OVER {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) * CAST(1.2 AS DOUBLE), CAST(0.01 AS DOUBLE)) AS thr FROM gs), "
    "cand AS (SELECT track_id, frame_idx, frame_idx * 8 / CAST(200 AS DOUBLE) AS pos FROM th WHERE s > l AND s >= r AND s > thr), " + greedy_sql("cand", "pos", "CAST(0.25 AS DOUBLE)")
)


@query("j2_flux_detector", with_views("samples", f"WITH {J2} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS beat_idx, {r('frame_idx * 8 / CAST(200 AS DOUBLE)')} AS t FROM kept", recursive=True))
def j2(spark, sf):
    return timed(detect.flux_beats(fx.samples(spark, sf), rate=fx.RATE, window=32, hop=8, sigma=1.5, factor=1.2), "track_id")


J3 = (
    FIR + ",\n" + RESAMPLE.format(ratio="CAST(0.5 AS DOUBLE)", src="fir") + ", " + ONSET_ENV.replace("FROM samples)", "FROM res)") + ", " + greedy_sql("cand", "pos", 3) + ", " + RESCUE.format(g=3)
    + ", beats AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS beat_idx, frame_idx / CAST(12.5 AS DOUBLE) AS t FROM allp)"
)


def onset_of(samples):
    return detect.onset_beats(samples, in_rate=fx.RATE, rate=100, n_fft=32, hop=8)


def onset(spark, sf):
    return onset_of(fx.samples(spark, sf))


@query("j3_onset_beats", with_views("samples", f"WITH {J3} SELECT track_id, beat_idx, {r('t')} AS t FROM beats", recursive=True))
def j3_beats(spark, sf):
    return timed(onset(spark, sf), "track_id")


J3_TEMPO = (
    f"{J3}, iv AS (SELECT * FROM (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS x FROM beats) WHERE x IS NOT NULL), {best_sql(200, 0.2, 2.0, False)}, {CANDIDATES}, "
    "rg AS (SELECT track_id, list_sort(list(x))[count(*) // 2 + 1] AS m, count(*) AS n FROM iv GROUP BY 1), "
    "cf AS (SELECT track_id, CASE WHEN n + 1 > 10 THEN greatest(0.0, 1 - sqrt(avg((x - m) * (x - m))) / m * 2) ELSE 0.0 END AS confidence FROM iv JOIN rg USING (track_id) GROUP BY track_id, n, m), "
    "al AS (SELECT c.track_id, n_beats, CASE WHEN n_beats >= 4 THEN coalesce(60.0 / candidate, 0) ELSE 0 END AS bpm, coalesce(confidence, 0) AS confidence FROM (SELECT track_id, count(*) AS n_beats FROM beats GROUP BY 1) c LEFT JOIN win USING (track_id) LEFT JOIN cf USING (track_id)), "
    f"fo AS (SELECT *, {DOWN} AS down FROM al)"
)


@query("j3_onset_detector", with_views("samples", f"WITH {J3_TEMPO} SELECT track_id, n_beats, {r(FOLD)} AS bpm, {r('confidence')} AS confidence FROM fo", recursive=True))
def j3(spark, sf):
    beats = stage(onset(spark, sf), "onset-beats")
    return detect.onset_tempo(beats).select("track_id", "n_beats", rnd("bpm").alias("bpm"), rnd("confidence").alias("confidence"))


J4_ARGS = dict(rate=200, hop=8, n_mels=6, n_fft=32, fmin=5.0, fmax=100.0)


J4_MEL = (
    framed(32, 8, "pad") + ", fr AS (SELECT track_id, frame_idx, pos AS n, v FROM framed), " + spec("{p}", "17", 32, "fr", HANN32) + ", " + mel_sql(200, 6, 32, 5.0, 100.0)
    + ", ml AS (SELECT track_id, frame_idx, mel AS bin, ln(greatest(sum(mag * weight), 1e-10)) AS mag FROM spec JOIN bank USING (bin) GROUP BY 1, 2, 3), "
)
J4 = (
    J4_MEL + FLUX.replace("FROM spec", "FROM ml")
    + f", {NORM_ACT}, {peaks_sql('act', 0.4, 'flat_left', 0.27, 25)}, jb AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS beat_idx, frame_idx / CAST(25 AS DOUBLE) AS t FROM kept)"
)


@query("j4_model_detector", with_views("samples", f"WITH {J4} SELECT track_id, beat_idx, {r('t')} AS t FROM jb", recursive=True))
def j4(spark, sf):
    return timed(detect.model_beats(fx.samples(spark, sf), in_rate=fx.RATE, threshold=0.4, **J4_ARGS), "track_id")


@query("j4_model_tempo", with_views("samples", f"WITH {J4}, iv AS (SELECT * FROM (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS x FROM jb) WHERE x IS NOT NULL), "
       f"md AS (SELECT track_id, 60.0 / list_sort(list(x))[count(*) // 2 + 1] AS bpm FROM iv GROUP BY 1) SELECT track_id, {r('coalesce(bpm, 0)')} AS bpm FROM (SELECT DISTINCT track_id FROM jb) LEFT JOIN md USING (track_id)", recursive=True))
def j4_tempo(spark, sf):
    beats = stage(detect.model_beats(fx.samples(spark, sf), in_rate=fx.RATE, threshold=0.4, **J4_ARGS), "model-beats")
    return tempo.median_bpm(beats).select("track_id", rnd("bpm").alias("bpm"))


def separated(samples, detector):
    parts = f"WITH RECURSIVE raw AS ({VIEWS['samples']}), {separation_sql(512)}, samples AS ({samples}), "
    return parts.replace("raw", "plain_samples") + detector


HEAD_LEVELS = {"beat": 0.4, "downbeat": 0.3, "segment": 0.2}


def heads(spark, sf):
    return detect.model_analysis(fx.samples(spark, sf), in_rate=fx.RATE, thresholds=HEAD_LEVELS, **J4_ARGS)


J4_DOWN = J4_MEL + FLUX.replace("FROM spec", "FROM (SELECT * FROM ml WHERE bin < 3)") + f", {NORM_ACT}, {peaks_sql('act', 0.3, 'flat_left', 0.54, 25)}"


@query("j4_downbeats", with_views("samples", f"WITH {J4_DOWN} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS beat_idx, {r('frame_idx / CAST(25 AS DOUBLE)')} AS t FROM kept", recursive=True))
def j4_downbeats(spark, sf):
    return timed(heads(spark, sf)["downbeats"], "track_id")


J4_SEG = (
    J4_MEL + FLUX.replace("FROM spec", "FROM ml").replace("greatest(d, 0)", "abs(d)") + f", {NORM_ACT}, {peaks_sql('act', 0.2, 'flat_left', 1.0, 25)}, "
    "sg AS (SELECT track_id, frame_idx, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS seg_idx, lead(frame_idx) OVER (PARTITION BY track_id ORDER BY frame_idx) AS nf FROM kept), "
    "hs AS (SELECT track_id, frame_idx, list(mag ORDER BY bin) AS h FROM ml GROUP BY 1, 2), ds AS (SELECT track_id, count(*) / CAST(200 AS DOUBLE) AS duration FROM samples GROUP BY 1), "
    "lb AS (SELECT s.*, h, duration FROM sg s JOIN ds USING (track_id) JOIN hs ON hs.track_id = s.track_id AND hs.frame_idx = CAST(floor(s.frame_idx / CAST(25 AS DOUBLE) * 25) AS BIGINT))"
)


@query("j4_segments", with_views("samples", f"WITH {J4_SEG} SELECT track_id, seg_idx, {r('frame_idx / CAST(25 AS DOUBLE)')} AS start_s, {r('coalesce(nf / CAST(25 AS DOUBLE), duration)')} AS end_s, "
       f"{LABEL_LIST}[list_position(h, list_max(h))] AS label, {r('1 / (1 + exp(-list_max(h)))')} AS confidence FROM lb", recursive=True))
def j4_segments(spark, sf):
    return heads(spark, sf)["segments"].select("track_id", "seg_idx", "label", *[rnd(c).alias(c) for c in ("start_s", "end_s", "confidence")])


DRUMS = "SELECT track_id, idx, v FROM sep WHERE stem = 'drums'"


@query("j5_stem_detector", separated(DRUMS, J1) + f" SELECT track_id, beat_idx, {r('t')} AS t FROM jb")
def j5(spark, sf):
    beats = detect.stem_detector(fx.samples(spark, sf), length=512, detector=lambda s: detect.energy_beats(s, rate=fx.RATE))
    return timed(beats, "track_id")


@query("j5_stem_onset", separated(DRUMS, J3) + f" SELECT track_id, beat_idx, {r('t')} AS t FROM beats")
def j5_onset(spark, sf):
    return timed(detect.stem_detector(fx.samples(spark, sf), length=512, detector=onset_of), "track_id")


@query("j5_stem_model", separated(DRUMS, J4) + f" SELECT track_id, beat_idx, {r('t')} AS t FROM jb")
def j5_model(spark, sf):
    beats = detect.stem_detector(fx.samples(spark, sf), length=512, detector=lambda s: detect.model_beats(s, in_rate=fx.RATE, threshold=0.4, **J4_ARGS))
    return timed(beats, "track_id")


@query("j5_per_stem_detector", separated("SELECT track_id || '/' || stem AS track_id, idx, v FROM sep", J1) + f" SELECT split_part(track_id, '/', 1) AS track_id, split_part(track_id, '/', 2) AS stem, beat_idx, {r('t')} AS t FROM jb")
def j5_stems(spark, sf):
    keys = ["track_id", "stem"]
    beats = detect.stem_detector(fx.samples(spark, sf), length=512, per_stem=True, detector=lambda s: detect.energy_beats(s, rate=fx.RATE, keys=keys))
    return timed(beats, *keys)


@query("j5_stereo_detector", f"WITH RECURSIVE {STEREO}" + RESAMPLE.format(ratio="(CAST(200 AS DOUBLE) / 160)", src="duo") + f", raw AS (SELECT * FROM res), {stereo_separation_sql(512)}, "
       f"samples AS (SELECT split_part(track_id, '/', 1) AS track_id, idx, avg(v) AS v FROM sep WHERE stem = 'drums' GROUP BY 1, 2), {J1} SELECT track_id, beat_idx, {r('t')} AS t FROM jb")
def j5_stereo(spark, sf):
    """Two channels brought from 160 to 200 values a second, separated, the drums made mono and detected on."""
    beats = detect.stereo_stem_detector(interleaved(spark, sf), in_rate=160, model_rate=200, length=512, detector=lambda s: detect.energy_beats(s, rate=fx.RATE))
    return timed(beats, "track_id")


# ---- K --------------------------------------------------------------------------------------


# Every chunk but a short last one is detected with the 20 samples kept before it
K1 = (
    f"WITH RECURSIVE raw AS ({VIEWS['samples']}), bf AS (SELECT track_id, unnest(CASE WHEN idx % 100 >= 80 THEN [idx // 100, idx // 100 + 1] ELSE [idx // 100] END) AS c, idx, v FROM raw), "
    "bl AS (SELECT track_id, c, idx - greatest(c * 100 - 20, 0) AS idx, v, count(*) OVER (PARTITION BY track_id, c) AS n FROM bf), "
    "samples AS (SELECT track_id || '/' || c AS track_id, idx, v FROM bl WHERE n >= 100), "
    + framed(16, 4, "full") + ", fr AS (SELECT track_id, frame_idx, pos AS n, v FROM framed), " + spec("sqrt({p})", "9", 16, "fr", "CAST(0.5 AS DOUBLE) * (1 - cos(2 * pi() * n / 15))")
    + f", {FLUX}, {NORM_ACT}, {peaks_sql('act', 0.3, 'flat_left', 0.27, 50)}, "
    "em AS (SELECT split_part(k.track_id, '/', 1) AS track_id, CAST(split_part(k.track_id, '/', 2) AS BIGINT) AS c, frame_idx / CAST(50 AS DOUBLE) AS t, n FROM kept k JOIN (SELECT track_id, count(*) AS n FROM samples GROUP BY 1) USING (track_id)) "
    f"SELECT track_id, {r('t + greatest(c * 100 - 20, 0) / CAST(200 AS DOUBLE)')} AS t FROM em WHERE t < (n - 20) / CAST(200 AS DOUBLE)"
)


CHUNKS = "track_id string, epoch bigint, chunk_no bigint, samples array<double>"


def run_stream(spark, chunks, source, sink, state):
    """Add ``chunks`` to the source folder and let the stream catch up from its checkpoint."""
    chunks.select("track_id", "epoch", "chunk_no", "samples").write.mode("append").parquet(source)
    live = spark.readStream.schema(CHUNKS).parquet(source)
    found = stream.detect_stream(live, rate=fx.RATE)
    job = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
    job.awaitTermination()
    return spark.read.schema(stream.OUTPUT).parquet(sink).filter("kind = 'beat'").select("track_id", "epoch", rnd("t").alias("t"))


def stream_places(spark):
    return [new_path(spark, p) for p in ("chunks", "stream-beats", "stream-state")]


@query("k1_chunk_stream", K1)
def k1(spark, sf):
    """Chunks as a file stream, detected with keyed state, collected by an available-now run."""
    return run_stream(spark, fx.chunks(spark, sf).withColumn("epoch", F.lit(0).cast("long")), *stream_places(spark)).drop("epoch")


@query("k2_stream_reset", f"WITH once AS ({K1}) SELECT track_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS epoch, t FROM once")
def k2(spark, sf):
    """The same chunks in three epochs, two of them in one batch, give the same beats in each."""
    data, places = stage(fx.chunks(spark, sf), "chunks"), stream_places(spark)
    both = data.withColumn("epoch", F.explode(F.expr("array(1L, 0L)")))
    run_stream(spark, both, *places)
    return run_stream(spark, data.withColumn("epoch", F.lit(2).cast("long")), *places)


# The last 100 samples once more as chunk -1, for the beats behind the last cut
K3 = K1.replace(
    "samples AS (SELECT track_id || '/' || c AS track_id, idx, v FROM bl WHERE n >= 100)",
    "ct AS (SELECT track_id, count(*) AS total, CASE WHEN total % 100 = 0 OR total % 100 >= 80 THEN total - 20 ELSE total // 100 * 100 - 20 END AS done FROM raw GROUP BY 1), "
    "samples AS (SELECT track_id || '/' || c AS track_id, idx, v FROM bl WHERE n >= 100 UNION ALL SELECT track_id || '/-1', idx - (total - 100), v FROM raw JOIN ct USING (track_id) WHERE idx >= total - 100)",
)
K3 = K3.replace("FROM em WHERE t <", "FROM em WHERE c >= 0 AND t <") + f" UNION ALL SELECT track_id, {r('t + (total - 100) / CAST(200 AS DOUBLE)')} AS t FROM em JOIN ct USING (track_id) WHERE c = -1 AND t >= (done - (total - 100)) / CAST(200 AS DOUBLE)"


@query("k3_stream_flush", K3)
def k3(spark, sf):
    """Chunks and an end mark for every track: the beats of the last samples come out as well."""
    data = stage(fx.chunks(spark, sf), "chunks")
    ends = data.groupBy("track_id").agg((F.max("chunk_no") + 1).alias("chunk_no")).withColumn("samples", F.lit(None).cast("array<double>"))
    marked = data.unionByName(ends).withColumn("epoch", F.lit(0).cast("long"))
    return run_stream(spark, marked, *stream_places(spark)).drop("epoch")


# ---- L --------------------------------------------------------------------------------------


@query("l1_not_ascending", with_views("beats", "WITH u AS (SELECT track_id, beat_idx, floor(t * 4) / 4 AS t FROM beats) "
       f"SELECT track_id, beat_idx, {r('t')} AS t FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS p FROM u) WHERE t <= p"))
def l1(spark, sf):
    coarse = fx.beats(spark, sf).withColumn("t", F.floor(F.col("t") * 4) / 4)
    return quality.not_ascending(coarse).select("track_id", "beat_idx", rnd("t").alias("t"))


@query("l2_beats_without_bpm", with_views("beats", "SELECT track_id, count(*) AS n_beats FROM (SELECT CASE WHEN track_id % 4 = 0 THEN track_id * 1000000 + beat_idx ELSE track_id END AS track_id FROM beats) GROUP BY 1 HAVING count(*) < 2"))
def l2(spark, sf):
    # every beat of each fourth track becomes a track of its own
    parted = fx.beats(spark, sf).selectExpr("CASE WHEN track_id % 4 = 0 THEN track_id * 1000000 + beat_idx ELSE track_id END AS track_id", "CASE WHEN track_id % 4 = 0 THEN 0L ELSE beat_idx END AS beat_idx", "t")
    return quality.beats_without_bpm(tempo.grid_summary(parted)).select("track_id", "n_beats")


@query("l3_peaks_out_of_range", with_views("samples", f"SELECT track_id, idx AS bucket, {r('abs(v) * 12')} AS peak FROM samples WHERE abs(v) * 12 > 1"))
def l3(spark, sf):
    peaks = fx.samples(spark, sf).select("track_id", F.col("idx").alias("bucket"), (F.abs("v") * 12).alias("peak"))
    return quality.peaks_out_of_range(peaks).select("track_id", "bucket", rnd("peak").alias("peak"))


@query("l4_silence", with_views("samples", "SELECT DISTINCT track_id FROM samples WHERE track_id IN ('view', 'click')"))
def l4(spark, sf):
    quiet = stage(fx.samples(spark, sf).withColumn("v", F.when(F.col("track_id").isin("view", "click"), 0.0).otherwise(F.col("v"))), "quiet")
    return quality.silent_tracks_without_beats(quiet, detect.energy_beats(quiet, rate=fx.RATE))


@query("l5_bpm_outside", with_views("beats", "WITH s AS (SELECT track_id, (max(t) - min(t)) / (count(*) - 1) AS a FROM beats GROUP BY 1) " f"SELECT track_id, {r('60.0 / a')} AS bpm FROM s WHERE 60.0 / a NOT BETWEEN 110 AND 130"))
def l5(spark, sf):
    return quality.bpm_outside(tempo.grid_summary(fx.beats(spark, sf))).select("track_id", rnd("bpm").alias("bpm"))


@query("l6_analysis_status", with_views("regions tracks", f"SELECT region_id, CASE WHEN coalesce(end_s - start_s - 3, 0) <= 0 THEN 'failed' ELSE 'ok' END AS status FROM regions"))
def l6(spark, sf):
    rows = fx.regions(spark, sf).select("region_id", (F.col("end_s") - F.col("start_s") - 3).alias("duration"))
    return quality.analysis_status(rows).select("region_id", "status")
