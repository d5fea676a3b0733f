"""Queries for the H family and J6: segmentation and edit lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.lookup_queries import IN_SEL, selection
from pulsegrid.catalog.registry import query
from pulsegrid.catalog.views import r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import segments
from pulsegrid.plans import edit_list
from pulsegrid.session import stage
from pulsegrid.sources import fixtures as fx

B = "(PARTITION BY track_id ORDER BY beat_idx)"


@query("h1_cut_at_beats", with_views("beats", f"SELECT track_id, beat_idx, {r('t')} AS start_s, {r(f'coalesce(lead(t) OVER {B}, t + 2.0)')} AS end_s FROM beats"))
def h1(spark, sf):
    return segments.cut_at_beats(fx.beats(spark, sf)).select("track_id", "beat_idx", rnd("start_s").alias("start_s"), rnd("end_s").alias("end_s"))


@query("h2_default_clip", with_views("beats", f"WITH c AS (SELECT track_id, coalesce(max(t) FILTER (beat_idx = 1) - max(t) FILTER (beat_idx = 0), 1.0) AS clip FROM beats GROUP BY 1) SELECT track_id, beat_idx, {r('t')} AS start_s, {r('t + clip')} AS end_s FROM beats JOIN c USING (track_id)"))
def h2(spark, sf):
    b = stage(fx.beats(spark, sf), "beats")
    joined = b.join(segments.default_clip(b, requested=0.0), "track_id")
    return segments.cut_at_beats(joined, clip=F.col("clip")).select("track_id", "beat_idx", rnd("start_s").alias("start_s"), rnd("end_s").alias("end_s"))


@query("h3_split_at_points", with_views("beats tracks", "WITH p AS (SELECT track_id, beat_idx + 1 AS ord, t * (1 - beat_idx % 3 * 0.5) AS t FROM beats UNION ALL SELECT track_id, 0, 0.0 FROM tracks UNION ALL SELECT track_id, n + 1, duration FROM tracks JOIN (SELECT track_id, count(*) AS n FROM beats GROUP BY 1) USING (track_id)), "
       "l AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY ord) AS nx FROM p) " f"SELECT track_id, ord AS part, {r('t')} AS start_s, {r('nx - t')} AS dur FROM l WHERE nx IS NOT NULL"))
def h3(spark, sf):
    jumpy = fx.beats(spark, sf).withColumn("t", F.col("t") * (1 - F.col("beat_idx") % 3 * F.lit(0.5)))
    out = segments.split_at(stage(jumpy, "points"), fx.tracks(spark, sf))
    return out.select("track_id", "part", rnd("start_s").alias("start_s"), rnd("dur").alias("dur"))


GAPS = (
    "iv AS (SELECT *, lead(t) OVER {B} AS nx, t - lag(t) OVER {B} AS x FROM {src}), "
    "lim AS (SELECT track_id, coalesce(avg(x) FILTER (x > CAST(0.05 AS DOUBLE) AND x < 5), 1.0) * 3 AS lim FROM iv GROUP BY 1), "
    "kd AS (SELECT track_id, beat_idx, CASE WHEN nx - t > lim THEN 'BREAKDOWN' ELSE 'BEAT' END AS kind, t, CASE WHEN nx IS NULL THEN 1.0 WHEN nx - t <= 0 THEN 0.1 ELSE nx - t END AS dur FROM iv JOIN lim USING (track_id) "
    "UNION ALL SELECT track_id, -1, 'INTRO', 0.0, t FROM iv JOIN lim USING (track_id) WHERE beat_idx = 0 AND t > lim)"
)
ROBIN = "rr AS (SELECT k.*, c.clip_id, c.duration AS d, c.path FROM (SELECT *, (row_number() OVER (PARTITION BY track_id ORDER BY beat_idx) - 1) % (SELECT count(*) FROM clips) AS turn FROM kd WHERE kind = 'BEAT') k JOIN clips c ON c.clip_id = k.turn)"
OFFSETS = (
    "so AS (SELECT *, CASE WHEN d - p < dur THEN 0.0 ELSE p END AS src_start, CASE WHEN d - p < dur THEN least(dur, d) ELSE dur END AS du FROM "
    "(SELECT *, CASE WHEN t % d < CAST(0.001 AS DOUBLE) THEN 0.0 ELSE t % d END AS p FROM rr))"
)


def gaps_sql(src="beats"):
    return GAPS.format(B=B, src=src)


def gap_rows(spark, sf):
    return segments.classify_gaps(fx.beats(spark, sf))


@query("h4_gap_kinds", with_views("beats", f"WITH {gaps_sql()} SELECT track_id, beat_idx, kind, {r('t')} AS t FROM kd"))
def h4(spark, sf):
    return gap_rows(spark, sf).select("track_id", "beat_idx", "kind", rnd("t").alias("t"))


@query("h5_round_robin", with_views("beats clips", f"WITH {gaps_sql()}, {ROBIN} SELECT track_id, beat_idx, clip_id FROM rr"))
def h5(spark, sf):
    return segments.round_robin(stage(gap_rows(spark, sf), "gaps"), fx.clips(spark, sf)).select("track_id", "beat_idx", "clip_id")


@query("h5_round_robin_by_index", with_views("beats clips", "SELECT track_id, beat_idx, beat_idx % (SELECT count(*) FROM clips) AS clip_id FROM beats"))
def h5_cli(spark, sf):
    return segments.round_robin(fx.beats(spark, sf), fx.clips(spark, sf), advance_on=None).select("track_id", "beat_idx", "clip_id")


@query("h6_source_offsets", with_views("beats clips", f"WITH {gaps_sql()}, {ROBIN}, {OFFSETS} SELECT track_id, beat_idx, clip_id, {r('src_start')} AS src_start, {r('du')} AS dur FROM so"))
def h6(spark, sf):
    clips = stage(fx.clips(spark, sf), "clips")
    out = segments.source_offsets(segments.round_robin(stage(gap_rows(spark, sf), "gaps"), clips), clips)
    return out.select("track_id", "beat_idx", "clip_id", rnd("src_start").alias("src_start"), rnd("dur").alias("dur"))


@query("h7_duration_floor", with_views("beats", f"WITH tight AS (SELECT track_id, beat_idx, floor(t) AS t FROM beats), {gaps_sql('tight')} SELECT track_id, beat_idx, kind, {r('dur')} AS dur FROM kd"))
def h7(spark, sf):
    tight = fx.beats(spark, sf).withColumn("t", F.floor("t").cast("double"))
    return segments.classify_gaps(tight).select("track_id", "beat_idx", "kind", rnd("dur").alias("dur"))


# one recursion step per clip used: (gap number, piece, time left, position in the cycle)
FILL = (
    "cy AS (SELECT clip_id, duration AS d, row_number() OVER (ORDER BY duration DESC, clip_id) - 1 AS p, count(*) OVER () AS nc FROM clips), "
    "gq AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY beat_idx) AS g FROM kd WHERE kind <> 'BEAT' AND dur >= CAST(0.1 AS DOUBLE)), "
    "fl(track_id, g, piece, lft, used, clip_id, pos) AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM gq "
    "UNION ALL SELECT fl.track_id, q.g, CASE WHEN q.g = fl.g THEN fl.piece + 1 ELSE 0 END, CASE WHEN q.g = fl.g THEN fl.lft ELSE q.dur END - least(cy.d, CASE WHEN q.g = fl.g THEN fl.lft ELSE q.dur END), "
    "least(cy.d, CASE WHEN q.g = fl.g THEN fl.lft ELSE q.dur END), cy.clip_id, (fl.pos + 1) % cy.nc "
    "FROM fl JOIN gq q ON q.track_id = fl.track_id AND q.g = CASE WHEN fl.lft > CAST(0.1 AS DOUBLE) THEN fl.g ELSE fl.g + 1 END JOIN cy ON cy.p = fl.pos), "
    "fills AS (SELECT fl.track_id, beat_idx, kind, piece, fl.clip_id, used FROM fl JOIN gq USING (track_id, g))"
)


@query("h8_gap_filling", with_views("beats clips", f"WITH {gaps_sql()}, {FILL} SELECT track_id, beat_idx, piece, clip_id, {r('used')} AS dur FROM fills", recursive=True))
def h8(spark, sf):
    gaps = gap_rows(spark, sf).filter("kind <> 'BEAT'")
    return segments.fill_long_gaps(gaps, stage(fx.clips(spark, sf), "clips")).select("track_id", "beat_idx", "piece", "clip_id", rnd("dur").alias("dur"))


CLI = f"cs AS (SELECT track_id, beat_idx, t, coalesce(lead(t) OVER {B} - t, greatest(duration - t, 0.5)) AS dur FROM beats JOIN (SELECT track_id, duration + track_id % 5 AS duration FROM tracks) USING (track_id))"


def longer(spark, sf):
    return fx.tracks(spark, sf).withColumn("duration", F.col("duration") + F.col("track_id") % 5)


@query("h9_cli_segments", with_views("beats tracks", f"WITH {CLI} SELECT track_id, beat_idx, 0.0 AS src_start, {r('dur')} AS dur FROM cs"))
def h9(spark, sf):
    return segments.cli_segments(fx.beats(spark, sf), longer(spark, sf)).select("track_id", "beat_idx", "src_start", rnd("dur").alias("dur"))


@query("h10_padding", with_views("beats tracks clips", f"WITH {CLI}, t AS (SELECT track_id, count(*) AS n, sum(dur) AS total FROM cs GROUP BY 1), l AS (SELECT track_id, n, duration + track_id % 9 - total AS lft FROM t JOIN tracks USING (track_id)), "
       "p AS (SELECT *, unnest(range(CAST(ceil((lft - CAST(0.1 AS DOUBLE)) / 2.0 - 1e-9) AS BIGINT))) AS k FROM l WHERE lft > 0.5) "
       f"SELECT track_id, n + k AS segment, (n + k) % (SELECT count(*) FROM clips) AS clip_id, {r('least(2.0, lft - 2.0 * k)')} AS dur FROM p"))
def h10(spark, sf):
    segs = segments.cli_segments(fx.beats(spark, sf), longer(spark, sf))
    totals = segs.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("dur").alias("total"))
    totals = totals.join(fx.tracks(spark, sf), "track_id").withColumn("duration", F.col("duration") + F.col("track_id") % 9)
    return segments.pad_to_length(totals, fx.clips(spark, sf)).select("track_id", "segment", "clip_id", rnd("dur").alias("dur"))


@query("h11_output_timeline", with_views("beats tracks", f"WITH {CLI} SELECT track_id, beat_idx, {r(f'coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY beat_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS out_start FROM cs"))
def h11(spark, sf):
    segs = stage(segments.cli_segments(fx.beats(spark, sf), longer(spark, sf)), "segments")
    return segments.output_timeline(segs, idx="beat_idx").select("track_id", "beat_idx", rnd("out_start").alias("out_start"))


@query("h12_segments_from_peaks", with_views("beats tracks", f"SELECT track_id, beat_idx AS seg_idx, {r('t')} AS start_s, {r(f'coalesce(lead(t) OVER {B}, duration)')} AS end_s FROM beats JOIN tracks USING (track_id)"))
def h12(spark, sf):
    peaks = fx.beats(spark, sf).withColumnRenamed("beat_idx", "seg_idx")
    return segments.segments_from_peaks(peaks, fx.tracks(spark, sf)).select("track_id", "seg_idx", rnd("start_s").alias("start_s"), rnd("end_s").alias("end_s"))


@query("h13_window_expressions", with_views("beats", "SELECT track_id, beat_idx // 30 AS chunk, string_agg(printf('between(t,%.6f,%.6f)', t, t + CAST(0.08 AS DOUBLE)), '+' ORDER BY beat_idx) AS enable FROM beats GROUP BY 1, 2"))
def h13(spark, sf):
    return segments.window_expressions(fx.beats(spark, sf), width=0.08)


@query("h14_filter_chain", "WITH c AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'colorbalance=rs=0.1:gs=0.05:bs=-0.05' WHEN '2-HIGH' THEN 'colorbalance=rs=-0.05:gs=0.0:bs=0.1' WHEN '3-MEDIUM' THEN 'eq=saturation=1.4:contrast=1.1' END AS col, "
       "CASE WHEN o_orderkey % 2 = 0 THEN 'vignette=PI/' || printf('%.6g', CAST(4 AS DOUBLE) / (CAST(o_custkey % 191 + 1 AS DOUBLE) / 100)) END AS vig, CASE WHEN o_orderkey % 3 = 0 THEN 'gblur=sigma=' || printf('%.6g', CAST(o_custkey % 173 + 1 AS DOUBLE) / 7) END AS blur FROM orders) "
       "SELECT o_orderkey, concat_ws(',', col, vig, blur) AS chain FROM c")
def h14(spark, sf):
    preset = F.create_map(*[F.lit(x) for x in ("1-URGENT", "warm", "2-HIGH", "cool", "3-MEDIUM", "vibrant", "4-NOT SPECIFIED", "none", "5-LOW", "none")])
    k = F.col("o_orderkey")
    c = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.lit(True).alias("enable_color"), F.try_element_at(preset, "o_orderpriority").alias("preset"),
        (k % 2 == 0).alias("enable_vignette"), ((F.col("o_custkey") % 191 + 1).cast("double") / 100).alias("vignette"),
        (k % 3 == 0).alias("enable_blur"), ((F.col("o_custkey") % 173 + 1).cast("double") / 7).alias("blur"),
    )
    return segments.filter_chain(c).select("o_orderkey", "chain")


@query("h15_transition_chain", "WITH j AS (SELECT o_orderkey, o_orderkey % 120 AS n, 'fx/it''s_' || o_orderstatus || '.glsl' AS path FROM orders) "
       "SELECT o_orderkey, CASE WHEN n >= 2 THEN list_aggregate(list_transform(range(n - 1), lambda i: CASE WHEN i = 0 THEN '[0:v]' ELSE '[t' || i || ']' END || '[' || (i + 1) || ':v]gltransition=source=''' || replace(path, '''', '\\''') || ''':duration=0.300[t' || (i + 1) || ']'), 'string_agg', ';') ELSE '' END AS graph FROM j")
def h15(spark, sf):
    o = fx.table(spark, sf, "orders")
    jobs = o.select("o_orderkey", (F.col("o_orderkey") % 120).alias("n_inputs"), F.concat(F.lit("fx/it's_"), F.col("o_orderstatus"), F.lit(".glsl")).alias("path"), F.lit(0.3).alias("duration"))
    return segments.transition_chain(jobs, "o_orderkey").select("o_orderkey", "graph")


SEG = "sg AS (SELECT track_id, seg, idx - seg * 48 AS pos, v FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((idx - 63) / 48.0) AS BIGINT)), idx // 48 + 1)) AS seg FROM samples))"


@query("h16_overlap_segments", with_views("samples", f"WITH {SEG} SELECT track_id, seg, pos, {r('v')} AS v FROM sg"))
def h16(spark, sf):
    return segments.overlap_segments(fx.samples(spark, sf), length=64).select("track_id", "seg", "pos", rnd("v").alias("v"))


@query("h17_overlap_add", with_views("samples", f"WITH {SEG}, z AS (SELECT track_id, seg, pos, v * (1 + seg % 3) AS v, max(pos) OVER (PARTITION BY track_id, seg) + 1 AS len FROM sg), "
       "w AS (SELECT *, seg * 48 + pos AS idx, CASE WHEN seg > 0 AND pos < 16 THEN pos / 16.0 * CASE WHEN len >= 16 AND pos >= len - 16 THEN (len - 1 - pos) / 16.0 ELSE 1.0 END END AS wt FROM z) "
       f"SELECT track_id, idx, {r('CASE WHEN arg_max(coalesce(wt, -1), seg) < 0 THEN arg_max(v, seg) ELSE arg_min(v, seg) * (1 - arg_max(wt, seg)) + arg_max(v, seg) * arg_max(wt, seg) END', 8)} AS v FROM w GROUP BY 1, 2"))
def h17(spark, sf):
    cut = segments.overlap_segments(fx.samples(spark, sf), length=64).withColumn("v", F.col("v") * (1 + F.col("seg") % 3))
    return segments.overlap_add(cut, length=64).select("track_id", "idx", rnd("v", 8).alias("v"))


@query("j6_edit_list", with_views("beats tracks clips", f"WITH {IN_SEL}, th AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY beat_idx) - 1 AS beat_idx, t FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY beat_idx) - 1 AS k FROM ins) WHERE k % 2 = 0), "
       + gaps_sql("th") + f", {ROBIN}, {OFFSETS}, {FILL}, mg AS (SELECT track_id, beat_idx, CAST(0 AS BIGINT) AS piece, kind, clip_id, src_start, du AS dur FROM so UNION ALL SELECT track_id, beat_idx, piece, kind, clip_id, 0.0, used FROM fills), "
       "o AS (SELECT *, row_number() OVER w - 1 AS seg_no, coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY beat_idx, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_start FROM mg WINDOW w AS (PARTITION BY track_id ORDER BY beat_idx, piece)) "
       f"SELECT track_id, seg_no, kind, clip_id, path, {r('src_start')} AS src_start, {r('dur')} AS dur, {r('out_start')} AS out_start FROM o JOIN (SELECT clip_id, path FROM clips) USING (clip_id)", recursive=True))
def j6(spark, sf):
    thin = edit_list.thin_beats(stage(fx.beats(spark, sf), "beats"), selection(spark, sf), rate=1)
    out = edit_list.edit_list(thin, stage(fx.clips(spark, sf), "clips"))
    return out.select("track_id", "seg_no", "kind", "clip_id", "path", *[rnd(c).alias(c) for c in ("src_start", "dur", "out_start")])
