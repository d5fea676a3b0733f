"""Queries for the F and G families: lookups, filters, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.registry import query
from pulsegrid.catalog.signal_queries import FX  # noqa: F401
from pulsegrid.catalog.views import r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import lookup, segments, signal, timeline
from pulsegrid.session import stage
from pulsegrid.sources import fixtures as fx

PROBES = "pr AS (SELECT track_id, region_id AS probe_id, start_s * 1.3 - 1.0 AS t FROM regions)"


def probes(spark, sf):
    return fx.regions(spark, sf).select("track_id", F.col("region_id").alias("probe_id"), (F.col("start_s") * F.lit(1.3) - 1.0).alias("t"))


NEAR = (
    "pv AS (SELECT pr.track_id, probe_id, pr.t, b.beat_idx AS pi, b.t AS pt FROM pr ASOF LEFT JOIN beats b ON pr.track_id = b.track_id AND pr.t > b.t), "
    "nx AS (SELECT pv.*, b.beat_idx AS ni, b.t AS nt FROM pv ASOF LEFT JOIN beats b ON pv.track_id = b.track_id AND pv.t <= b.t)"
)


@query("f1_nearest_beat", with_views("beats regions", f"WITH {PROBES}, {NEAR} SELECT track_id, probe_id, {r('t')} AS t, CASE WHEN nt IS NULL OR t - pt < nt - t THEN pi ELSE ni END AS nearest_idx, "
       f"{r('coalesce(CASE WHEN nt IS NULL OR t - pt < nt - t THEN pt ELSE nt END, 0.0)')} AS nearest_t FROM nx"))
def f1(spark, sf):
    near = lookup.nearest_beat(probes(spark, sf), stage(fx.beats(spark, sf), "beats"))
    return near.select("track_id", "probe_id", rnd("t").alias("t"), "nearest_idx", rnd("nearest_t").alias("nearest_t"))


@query("f2_beat_at_index", with_views("beats regions", f"SELECT r.track_id, region_id, r.i AS beat_idx, {r('coalesce(t, 0)')} AS t FROM (SELECT track_id, region_id, region_id % 97 AS i FROM regions) r LEFT JOIN beats b ON b.track_id = r.track_id AND b.beat_idx = r.i"))
def f2(spark, sf):
    asks = fx.regions(spark, sf).select("track_id", "region_id", (F.col("region_id") % 97).alias("beat_idx"))
    return lookup.beat_at(asks, fx.beats(spark, sf)).select("track_id", "region_id", "beat_idx", rnd("t").alias("t"))


@query("f3_beat_near", with_views("beats regions tracks", f"WITH {PROBES}, {NEAR}, w AS (SELECT nx.*, duration, (10.0 / 800) * (duration / (1 + probe_id % 5)) AS tol FROM nx LEFT JOIN tracks USING (track_id)) "
       "SELECT track_id, probe_id, CASE WHEN least(coalesce(t - pt, 1e9), coalesce(nt - t, 1e9)) < tol THEN CASE WHEN coalesce(t - pt, 1e9) <= coalesce(nt - t, 1e9) THEN pi ELSE ni END ELSE -1 END AS beat_idx FROM w"))
def f3(spark, sf):
    p = probes(spark, sf).join(fx.tracks(spark, sf), "track_id", "left").withColumn("zoom", (1 + F.col("probe_id") % 5).cast("double"))
    tolerance = F.lit(10.0 / 800) * (F.col("duration") / F.col("zoom"))
    return lookup.beat_near(p, stage(fx.beats(spark, sf), "beats"), tolerance).select("track_id", "probe_id", "beat_idx")


@query("f4_region_at_time", with_views("beats regions", f"SELECT track_id, beat_idx, {r('any_value(t)')} AS t, coalesce(max(region_id), -1) AS region_id FROM (SELECT b.track_id, b.beat_idx, b.t, g.region_id FROM beats b LEFT JOIN regions g ON g.track_id = b.track_id AND b.t BETWEEN g.start_s AND g.end_s) GROUP BY 1, 2"))
def f4(spark, sf):
    found = lookup.last_region_at(fx.beats(spark, sf), fx.regions(spark, sf), probe_id="beat_idx")
    return found.select("track_id", "beat_idx", rnd("t").alias("t"), "region_id")


def frame_times(spark, sf, fps=10):
    """One probe per video frame of each track; track lengths are bounded by the calendar span of the data."""
    t = fx.tracks(spark, sf).withColumn("probe_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") * fps))))
    return t.select("track_id", "probe_id", (F.col("probe_id") / float(fps)).alias("t"))


def f5_sql(width):
    return with_views("beats tracks", "WITH fr AS (SELECT track_id, i AS probe_id, i / 10.0 AS t FROM (SELECT track_id, unnest(range(CAST(floor(duration * 10) AS BIGINT) + 1)) AS i FROM tracks)), "
                      "lb AS (SELECT fr.*, b.t AS bt FROM fr ASOF LEFT JOIN beats b ON fr.track_id = b.track_id AND fr.t >= b.t) "
                      f"SELECT track_id, probe_id, coalesce(t <= bt + CAST({width} AS DOUBLE), false) AS active FROM lb")


@query("f5_flash_windows", f5_sql(0.08))
def f5_flash(spark, sf):
    return lookup.inside_beat_window(frame_times(spark, sf), stage(fx.beats(spark, sf), "beats"), width=0.08).select("track_id", "probe_id", "active")


@query("f5_zoom_windows", f5_sql(0.15))
def f5_zoom(spark, sf):
    return lookup.inside_beat_window(frame_times(spark, sf), stage(fx.beats(spark, sf), "beats"), width=0.15).select("track_id", "probe_id", "active")


# The greedy claim by recursion over detections: state is the last claimed expected beat
MATCH = (
    "cl(track_id, beat_idx, truth_idx, last) AS (SELECT track_id, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(-1 AS BIGINT) FROM beats WHERE beat_idx = 0 "
    "UNION ALL SELECT b.track_id, b.beat_idx, m.i, coalesce(m.i, cl.last) FROM cl JOIN beats b ON b.track_id = cl.track_id AND b.beat_idx = cl.beat_idx + 1 "
    "LEFT JOIN LATERAL (SELECT min(truth_idx) AS i FROM truth t WHERE t.track_id = b.track_id AND t.truth_idx > cl.last AND abs(b.t - t.t) <= CAST(0.05 AS DOUBLE)) m ON true)"
)


@query("f6_truth_matching", with_views("beats truth", f"WITH {MATCH} SELECT track_id, beat_idx, truth_idx FROM cl WHERE truth_idx IS NOT NULL", recursive=True))
def f6(spark, sf):
    b, e = stage(fx.beats(spark, sf), "beats"), stage(fx.truth(spark, sf), "truth")
    return lookup.match_truth(b, e).select("track_id", "beat_idx", "truth_idx")


@query("f6_match_scores", with_views("beats truth", f"WITH {MATCH}, c AS (SELECT track_id, d AS detected, e AS expected, coalesce(m, 0) AS matched FROM (SELECT track_id, count(*) AS d FROM beats GROUP BY 1) JOIN (SELECT track_id, count(*) AS e FROM truth GROUP BY 1) USING (track_id) "
       "LEFT JOIN (SELECT track_id, count(*) AS m FROM cl WHERE truth_idx IS NOT NULL GROUP BY 1) USING (track_id)) "
       f"SELECT track_id, detected, expected, matched, {r('matched / CAST(detected AS DOUBLE)')} AS \"precision\", {r('matched / CAST(expected AS DOUBLE)')} AS recall, {r('2.0 * matched / (detected + expected)')} AS f1 FROM c", recursive=True))
def f6_scores(spark, sf):
    b, e = stage(fx.beats(spark, sf), "beats"), stage(fx.truth(spark, sf), "truth")
    s = lookup.match_scores(b, e, lookup.match_truth(b, e))
    return s.select("track_id", "detected", "expected", "matched", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")])


LABEL_LIST = "['intro','verse','pre-chorus','chorus','post-chorus','bridge','outro','instrumental','solo','silence']"


@query("f7_segment_labels", with_views("frames", "WITH n AS (SELECT track_id, max(frame_idx) AS last FROM frames GROUP BY 1), s AS (SELECT track_id, frame_idx AS seg_idx, frame_idx * 1.7 - 2 AS start_s, last FROM frames JOIN n USING (track_id)), "
       "a AS (SELECT s.track_id, seg_idx, x[1:10] AS h FROM s JOIN frames f ON f.track_id = s.track_id AND f.frame_idx = CAST(least(greatest(floor(start_s * 0.5), 0), last) AS BIGINT)) "
       f"SELECT track_id, seg_idx, {LABEL_LIST}[list_position(h, list_max(h))] AS label, {r('1 / (1 + exp(-list_max(h)))')} AS confidence FROM a"))
def f7(spark, sf):
    f = stage(fx.frames(spark, sf), "frames")
    segs = f.select("track_id", F.col("frame_idx").alias("seg_idx"), (F.col("frame_idx") * F.lit(1.7) - 2).alias("start_s"), F.lit(0.0).alias("end_s"))
    lengths = f.groupBy("track_id").agg((F.max("frame_idx") + 1).alias("n_frames"))
    out = lookup.segment_labels(segs, f, lengths, rate=0.5)
    return out.select("track_id", "seg_idx", "label", rnd("confidence").alias("confidence"))


@query("f8_transition_lookup", "WITH c AS (SELECT DISTINCT lower(p_name) AS name, 'fx/' || replace(lower(p_name), ' ', '_') || '.glsl' AS path FROM part UNION ALL SELECT 'fade', 'fx/fade.glsl'), "
       "q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'fx/' || replace(lower(p_name), ' ', '_') || '.glsl' ELSE 'no such ' || p_partkey END AS wanted FROM part) "
       "SELECT p_partkey, wanted, coalesce(a.name, 'fade') AS resolved FROM q LEFT JOIN (SELECT name AS w, name FROM c UNION SELECT path, name FROM c) a ON a.w = q.wanted")
def f8(spark, sf):
    p = fx.table(spark, sf, "part")
    path = F.concat(F.lit("fx/"), F.translate(F.lower("p_name"), " ", "_"), F.lit(".glsl"))
    names = p.select(F.lower("p_name").alias("name"), path.alias("path")).distinct()
    fade = p.limit(1).select(F.lit("fade").alias("name"), F.lit("fx/fade.glsl").alias("path"))
    wanted = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_name")).when(F.col("p_partkey") % 3 == 1, path).otherwise(F.concat(F.lit("no such "), F.col("p_partkey").cast("string")))
    return lookup.resolve_transition(p.select("p_partkey", wanted.alias("wanted")), names.unionByName(fade)).select("p_partkey", "wanted", "resolved")


@query("f9_missing_files", with_views("beats", "SELECT track_id, beat_idx, 'seg/' || track_id || '_' || beat_idx || '.mp4' AS path FROM beats b WHERE NOT EXISTS "
       "(SELECT 1 FROM orders o WHERE o.o_custkey // 10 = b.track_id AND o.o_orderkey % 97 = b.beat_idx)"))
def f9(spark, sf):
    segs = fx.beats(spark, sf).select("track_id", "beat_idx", F.format_string("seg/%d_%d.mp4", "track_id", "beat_idx").alias("path"))
    files = fx.table(spark, sf, "orders").select(F.format_string("seg/%d_%d.mp4", F.expr("o_custkey div 10"), F.col("o_orderkey") % 97).alias("path"))
    return lookup.missing_files(segs, files).select("track_id", "beat_idx", "path")


@query("f10_stem_effects", with_views("stem_beats", f"SELECT track_id, stem, effect, beat_idx, {r('t')} AS t FROM stem_beats JOIN (VALUES ('click', 'Flash'), ('view', 'Zoom'), ('signup', 'Vignette')) c(stem, effect) USING (stem)"))
def f10(spark, sf):
    b = stage(fx.stem_beats(spark, sf), "stems")
    chosen = {"click": ("Flash", True), "view": ("Zoom", True), "signup": ("Vignette", True), "purchase": ("ColorGrade", False), "error": ("None", True)}
    config = spark.createDataFrame([(k, e, on) for k, (e, on) in chosen.items()], "stem string, effect string, enabled boolean")
    return lookup.stem_effects(b, config).select("track_id", "stem", "effect", "beat_idx", rnd("t").alias("t"))


# ---- G -------------------------------------------------------------------------------------

SEL = "sel AS (SELECT track_id, duration, CAST(track_id % 9 AS DOUBLE) AS sel_start, CASE WHEN track_id % 4 = 0 THEN -1.0 ELSE CAST(track_id % 9 + 6 + track_id % 13 AS DOUBLE) END AS sel_end FROM tracks)"


def selection(spark, sf):
    return fx.tracks(spark, sf).select(
        "track_id", "duration", (F.col("track_id") % 9).cast("double").alias("sel_start"),
        F.when(F.col("track_id") % 4 == 0, -1.0).otherwise((F.col("track_id") % 9 + 6 + F.col("track_id") % 13).cast("double")).alias("sel_end"),
    )


IN_SEL = f"{SEL}, ins AS (SELECT track_id, beat_idx, t - sel_start AS t FROM beats JOIN sel USING (track_id) WHERE t >= sel_start AND t <= CASE WHEN sel_end > 0 THEN sel_end ELSE duration END)"


def bt(df):
    return df.select("track_id", "beat_idx", rnd("t").alias("t"))


@query("g1_selection", with_views("beats tracks", f"WITH {IN_SEL} SELECT track_id, beat_idx, {r('t')} AS t FROM ins"))
def g1(spark, sf):
    return bt(timeline.select_beats(fx.beats(spark, sf), selection(spark, sf)))


@query("g2_every_nth", with_views("beats tracks", f"WITH {IN_SEL} SELECT track_id, beat_idx, {r('t')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY beat_idx) - 1 AS k FROM ins) WHERE k % 4 = 0"))
def g2(spark, sf):
    return bt(timeline.every_nth(timeline.select_beats(fx.beats(spark, sf), selection(spark, sf)), 2))


@query("g2_every_nth_edited", with_views("beats", f"SELECT track_id, beat_idx, {r('t')} AS t FROM beats WHERE beat_idx % 8 = 0"))
def g2_edited(spark, sf):
    return bt(timeline.every_nth(fx.beats(spark, sf), 5, edited=True))


@query("g3_effect_beats", with_views("beats tracks", f"WITH {SEL} SELECT track_id, beat_idx, {r('t')} AS t FROM beats JOIN sel USING (track_id) WHERE beat_idx % (1 + track_id % 4) = 0 AND (sel_start <= 0 OR t >= sel_start) AND (sel_end <= 0 OR t <= sel_end)"))
def g3(spark, sf):
    b = fx.beats(spark, sf).join(selection(spark, sf), "track_id")
    return bt(timeline.effect_beats(b, divisor=1 + F.col("track_id") % 4, start=F.col("sel_start"), end=F.col("sel_end")))


def sql_clamp(v, lo, hi):
    return f"CASE WHEN {v} < {lo} THEN {lo} WHEN {v} > {hi} THEN {hi} ELSE {v} END"


@query("g4_clamp_selection", with_views("tracks regions", f"WITH a AS (SELECT region_id, duration, start_s * 1.5 - 5 AS s, end_s AS e FROM regions JOIN tracks USING (track_id)), b AS (SELECT region_id, duration, e, {sql_clamp('s', '0.0', 'duration')} AS s FROM a) "
       f"SELECT region_id, {r('s')} AS sel_start, {r(sql_clamp('e', 's', 'duration'))} AS sel_end FROM b"))
def g4(spark, sf):
    asks = fx.regions(spark, sf).join(fx.tracks(spark, sf), "track_id").select("region_id", "duration", (F.col("start_s") * 1.5 - 5).alias("sel_start"), F.col("end_s").alias("sel_end"))
    return timeline.clamp_selection(asks).select("region_id", rnd("sel_start").alias("sel_start"), rnd("sel_end").alias("sel_end"))


CLAMPED = f"{SEL}, cr AS (SELECT g.*, sel_start, CASE WHEN sel_end < 0 THEN duration ELSE sel_end END AS se FROM regions g JOIN sel USING (track_id)), cs AS (SELECT *, {sql_clamp('start_s', 'sel_start', 'se')} AS s FROM cr)"


@query("g5_clamp_regions", with_views("tracks regions", f"WITH {CLAMPED} SELECT track_id, region_id, effect, {r('s')} AS start_s, {r(sql_clamp('end_s', 's', 'se'))} AS end_s FROM cs"))
def g5(spark, sf):
    out = timeline.clamp_regions(fx.regions(spark, sf), selection(spark, sf))
    return out.select("track_id", "region_id", "effect", rnd("start_s").alias("start_s"), rnd("end_s").alias("end_s"))


@query("g6_first_region_bounds", with_views("tracks regions", f"WITH {SEL}, f AS (SELECT track_id, arg_min(start_s, region_id) AS s, arg_min(end_s, region_id) AS e FROM regions GROUP BY 1) "
       f"SELECT track_id, {r('coalesce(greatest(0.0, s - sel_start), 0.0)')} AS effect_start, {r('coalesce(e - sel_start, -1.0)')} AS effect_end FROM sel LEFT JOIN f USING (track_id)"))
def g6(spark, sf):
    out = timeline.first_region_bounds(selection(spark, sf), fx.regions(spark, sf))
    return out.select("track_id", rnd("effect_start").alias("effect_start"), rnd("effect_end").alias("effect_end"))


@query("g7_region_edits", with_views("tracks regions", f"WITH {CLAMPED} SELECT track_id, region_id, effect, {r('start_s')} AS start_s, {r('end_s')} AS end_s, enabled FROM regions WHERE NOT enabled AND effect <> '5-LOW' AND track_id % 10 <> 3 "
       f"UNION ALL SELECT track_id, region_id, effect, {r('s')}, {r(sql_clamp('end_s', 's', 'se'))}, true FROM cs WHERE enabled AND track_id % 10 <> 3"))
def g7(spark, sf):
    g = fx.regions(spark, sf)
    kept = timeline.remove_regions(g.filter("NOT enabled"), g.filter("effect = '5-LOW'"))
    grown = timeline.add_regions(kept, g.filter("enabled"), selection(spark, sf))
    out = timeline.clear_regions(grown, fx.tracks(spark, sf).filter("track_id % 10 = 3"))
    return out.select("track_id", "region_id", "effect", rnd("start_s").alias("start_s"), rnd("end_s").alias("end_s"), "enabled")


VIEW = (
    "vw AS (SELECT region_id, track_id, start_s, duration, least(greatest(region_id % 70 - 5.0, 1.0), 50.0) AS zoom, region_id % 11 / 10.0 - 0.05 AS sc FROM regions JOIN tracks USING (track_id)), "
    "vr AS (SELECT *, CASE WHEN sc < 0 THEN 0.0 WHEN sc > 1 - 1 / zoom THEN 1 - 1 / zoom ELSE sc END AS scroll FROM vw), "
    "vs AS (SELECT *, scroll * duration AS a, least(scroll * duration + duration / zoom, duration) AS b FROM vr)"
)


def views(spark, sf):
    g = fx.regions(spark, sf).join(fx.tracks(spark, sf), "track_id")
    return g.select("region_id", "track_id", "start_s", "duration", (F.col("region_id") % 70 - 5.0).alias("zoom"), (F.col("region_id") % 11 / 10.0 - 0.05).alias("scroll"))


@query("g8_visible_range", with_views("tracks regions", f"WITH {VIEW} SELECT region_id, {r('zoom')} AS zoom, {r('scroll')} AS scroll, {r('a')} AS vis_start, {r('b')} AS vis_end FROM vs"))
def g8(spark, sf):
    return timeline.visible_range(views(spark, sf)).select("region_id", *[rnd(c).alias(c) for c in ("zoom", "scroll", "vis_start", "vis_end")])


@query("g9_pixel_time", with_views("tracks regions", f"WITH {VIEW} SELECT region_id, {r('a + (region_id % 800 / 800.0) * (b - a)')} AS t, {r('(start_s - a) / (b - a) * 800', 4)} AS px FROM vs"))
def g9(spark, sf):
    ranged, width = timeline.visible_range(views(spark, sf)), F.lit(800.0)
    t = timeline.pixel_to_time((F.col("region_id") % 800).cast("double"), width)
    return ranged.select("region_id", rnd(t).alias("t"), rnd(timeline.time_to_pixel(F.col("start_s"), width), 4).alias("px"))


@query("g10_viewport_peaks", with_views("samples", "WITH pk AS (SELECT track_id, idx AS bucket, abs(v) * 12 AS peak FROM samples), n AS (SELECT track_id, max(bucket) + 1 AS n FROM pk GROUP BY 1), "
       "b AS (SELECT track_id, n, n / 200.0 AS duration FROM n), v AS (SELECT *, CAST(0.25 AS DOUBLE) * duration AS a, least(CAST(0.25 AS DOUBLE) * duration + duration / 2, duration) AS z FROM b), "
       "lim AS (SELECT track_id, CAST(greatest(0, floor(a / duration * n) - 1) AS BIGINT) AS lo, CAST(least(n, ceil(z / duration * n) + 1) AS BIGINT) AS hi FROM v), "
       "st AS (SELECT *, greatest(1, CAST(floor(greatest(1, ceil((hi - lo) / 100.0)) / 2) AS BIGINT)) AS step FROM lim) "
       f"SELECT track_id, (bucket - lo) // step * step + lo AS peak_idx, {r('least(max(peak), 1.0)')} AS peak FROM pk JOIN st USING (track_id) WHERE bucket >= lo AND bucket < hi GROUP BY 1, 2"))
def g10(spark, sf):
    peaks = stage(fx.samples(spark, sf).select("track_id", F.col("idx").alias("bucket"), (F.abs("v") * 12).alias("peak")), "peaks")
    v = peaks.groupBy("track_id").agg(((F.max("bucket") + 1) / 200.0).alias("duration")).select("track_id", "duration", F.lit(2.0).alias("zoom"), F.lit(0.25).alias("scroll"))
    return timeline.viewport_peaks(peaks, v, width=100).select("track_id", "peak_idx", rnd("peak").alias("peak"))


BANDS3 = {"bass": ("abs(v) * 12",), "mid": ("abs(v) * (idx % 3 + 1) * 3",), "high": ("abs(v) * (idx % 5) * 2.5D", "abs(v) * (idx % 5) * CAST(2.5 AS DOUBLE)")}
VIEWS3 = [(0, 1.0, 0.0), (1, 3.0, 0.25), (2, 40.0, 0.6), (3, 0.5, 0.9)]


@query("g10_band_viewport", with_views("samples", "WITH pk AS (SELECT track_id, idx AS bucket, " + ", ".join(f"{e[-1]} AS {b}" for b, e in BANDS3.items()) + " FROM samples), "
       "n AS (SELECT track_id, max(bucket) + 1 AS n, (max(bucket) + 1) / 200.0 AS duration FROM pk GROUP BY 1), "
       "w AS (SELECT *, least(greatest(z0, 1.0), 50.0) AS zoom FROM n, (VALUES " + ", ".join(f"({i}, CAST({z} AS DOUBLE), CAST({c} AS DOUBLE))" for i, z, c in VIEWS3) + ") t(view_id, z0, s0)), "
       "v AS (SELECT *, least(greatest(s0, 0.0), 1.0 - 1.0 / zoom) * duration AS a FROM w), z AS (SELECT *, least(a + duration / zoom, duration) AS b FROM v), "
       "lim AS (SELECT *, CAST(greatest(0, floor(a / duration * n) - 1) AS BIGINT) AS lo, CAST(least(n, ceil(b / duration * n) + 1) AS BIGINT) AS hi FROM z), "
       "st AS (SELECT *, greatest(1, CAST(floor(greatest(1, ceil((hi - lo) / CAST(60 AS DOUBLE))) / 2) AS BIGINT)) AS step FROM lim), "
       "br AS (SELECT *, greatest(1.0, CAST(60 AS DOUBLE) * step / (hi - lo + 1)) AS bar FROM st), "
       "g AS (SELECT br.*, (bucket - lo) // step * step + lo AS peak_idx, bass, mid, high FROM pk JOIN br USING (track_id) WHERE bucket >= lo AND bucket < hi), "
       "x AS (SELECT *, (CAST(peak_idx AS DOUBLE) / n * duration - a) / (b - a) * 60 AS x FROM g) "
       f"SELECT track_id, view_id, peak_idx, {r('x')} AS x, {r('bar')} AS bar_width, {r('least(max(bass), 1.0)')} AS bass, {r('least(max(mid), 1.0)')} AS mid, {r('least(max(high), 1.0)')} AS high "
       "FROM x WHERE x >= -bar AND x <= 60 + bar GROUP BY ALL"))
def g10_bands(spark, sf):
    peaks = fx.samples(spark, sf).select("track_id", F.col("idx").alias("bucket"), *[F.expr(e[0]).alias(b) for b, e in BANDS3.items()])
    levels, sizes = timeline.peak_pyramid(peaks, list(BANDS3))
    asked = sizes.select("track_id", (F.col("n_peaks") / 200.0).alias("duration"), F.explode(F.array(*[F.struct(F.lit(i).alias("view_id"), F.lit(z).alias("zoom"), F.lit(c).alias("scroll")) for i, z, c in VIEWS3])).alias("v"))
    bars = timeline.viewport_bars(levels, sizes, asked.select("track_id", "duration", "v.*"), list(BANDS3), width=60)
    return bars.select("track_id", "view_id", "peak_idx", *[rnd(c).alias(c) for c in ("x", "bar_width", *BANDS3)])


@query("g11_config_errors", "SELECT o_orderkey, CASE WHEN (o_orderstatus <> 'P' AND o_orderpriority IN ('5-LOW')) OR o_orderkey % 5 - 1 <= 0 THEN 2 ELSE 0 END AS error_code FROM orders")
def g11(spark, sf):
    o = fx.table(spark, sf, "orders")
    c = o.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("enable_transitions"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("transition_type"), (F.col("o_orderkey") % 5 - 1).alias("divisor"))
    return timeline.config_error(c).select("o_orderkey", "error_code")


@query("g12_effect_intensity", f"SELECT o_orderkey, {r('least(greatest(o_totalprice / 300000, CAST(0.1 AS DOUBLE)), 1.0)')} AS flash, {r('least(greatest(o_totalprice / 2000000, CAST(0.01 AS DOUBLE)), CAST(0.15 AS DOUBLE))')} AS zoom FROM orders")
def g12(spark, sf):
    flash, zoom = timeline.effect_intensity(F.col("o_totalprice") / 300000, F.col("o_totalprice") / 2000000)
    return fx.table(spark, sf, "orders").select("o_orderkey", rnd(flash).alias("flash"), rnd(zoom).alias("zoom"))


@query("g13_audio_trim", with_views("regions", f"WITH a AS (SELECT region_id, start_s - 2 AS s, end_s - region_id % 6 - 1 AS e FROM regions) SELECT region_id, {r('greatest(0.0, s)')} AS clip_start, e > 0 AND e > s + CAST(0.001 AS DOUBLE) AS clip_audio, "
       f"{r('CASE WHEN e > 0 AND e > s + CAST(0.001 AS DOUBLE) THEN e - s ELSE 0 END')} AS clip_dur FROM a"))
def g13(spark, sf):
    a = fx.regions(spark, sf).select("region_id", (F.col("start_s") - 2).alias("audio_start"), (F.col("end_s") - F.col("region_id") % 6 - 1).alias("audio_end"))
    return timeline.audio_trim(a).select("region_id", rnd("clip_start").alias("clip_start"), "clip_audio", rnd("clip_dur").alias("clip_dur"))


@query("g14_frame_count", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 7 > 0 THEN CAST(floor(p_retailprice / 100 * 30) AS BIGINT) ELSE 0 END ELSE p_partkey END AS total_frames FROM part")
def g14(spark, sf):
    p = fx.table(spark, sf, "part")
    c = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_partkey")).alias("nb_frames"), (F.col("p_retailprice") / 100).alias("duration"), F.when(F.col("p_size") % 7 > 0, 30.0).otherwise(0.0).alias("fps"))
    return timeline.frame_count(c).select("p_partkey", "total_frames")
