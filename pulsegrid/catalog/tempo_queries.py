"""Queries for the D and E families: tempo and beat grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.registry import query
from pulsegrid.catalog.views import r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import grid, tempo
from pulsegrid.operators.sequence import dense_index
from pulsegrid.session import stage
from pulsegrid.sources import fixtures as fx

IV = "iv AS (SELECT * FROM (SELECT track_id, beat_idx, t, t - lag(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS x FROM beats) WHERE x IS NOT NULL)"


def b_sql(body, views="beats"):
    return with_views(views, f"WITH {IV}, {body}" if body.strip()[:6].upper() != "SELECT" else f"WITH {IV} {body}")


def iv(spark, sf):
    return tempo.intervals(fx.beats(spark, sf))


@query("d1_intervals", b_sql(f"SELECT track_id, beat_idx, {r('x')} AS x FROM iv"))
def d1(spark, sf):
    return iv(spark, sf).select("track_id", "beat_idx", rnd("x").alias("x"))


@query("d2_upper_median", b_sql(f"SELECT track_id, count(*) AS n, {r('list_sort(list(x))[count(*) // 2 + 1]')} AS median FROM iv GROUP BY 1"))
def d2(spark, sf):
    return tempo.upper_median(iv(spark, sf)).select("track_id", F.col("n").cast("long").alias("n"), rnd("median").alias("median"))


def mode_sql(k, src="iv", name="md"):
    return f"{name} AS (SELECT track_id, bin, c, bin / {k}.0 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY c DESC, bin) AS rn FROM (SELECT track_id, CAST(trunc(x * {k}) AS BIGINT) AS bin, count(*) AS c FROM {src} GROUP BY 1, 2)) WHERE rn = 1)"


@query("d3_interval_mode", b_sql(f"{mode_sql(200)} SELECT track_id, bin, c AS \"count\", {r('mode')} AS mode FROM md"))
def d3(spark, sf):
    return tempo.mode_bin(iv(spark, sf), bins_per_second=200).select("track_id", "bin", "count", rnd("mode").alias("mode"))


def best_sql(k, lo, hi, gaps, src="iv"):
    pick = "CASE WHEN c < greatest(1, n // 5) THEN median ELSE mode END" if gaps else "CASE WHEN c > greatest(1, n // 5) THEN mode ELSE median END"
    return (
        f"va AS (SELECT * FROM {src} WHERE x > CAST({lo} AS DOUBLE) AND x < CAST({hi} AS DOUBLE)), {mode_sql(k, 'va')}, mn AS (SELECT track_id, count(*) AS n, list_sort(list(x))[count(*) // 2 + 1] AS median FROM va GROUP BY 1), "
        f"best AS (SELECT track_id, {pick} AS best FROM md JOIN mn USING (track_id))"
    )


@query("d4_dominant_interval", b_sql(f"{best_sql(200, 0.2, 2.0, False)} SELECT track_id, {r('best')} AS best FROM best"))
def d4(spark, sf):
    return tempo.dominant_interval(iv(spark, sf), low=0.2, high=2.0, bins_per_second=200, for_gaps=False).select("track_id", rnd("best").alias("best"))


@query("d4_dominant_interval_gaps", b_sql(f"{best_sql(100, 0.15, 1.5, True)} SELECT track_id, {r('best')} AS best FROM best"))
def d4_gaps(spark, sf):
    return tempo.dominant_interval(iv(spark, sf), low=0.15, high=1.5, bins_per_second=100, for_gaps=True).select("track_id", rnd("best").alias("best"))


CANDIDATES = (
    "cd AS (SELECT track_id, best, o, CASE o WHEN 0 THEN best WHEN 1 THEN best * 2 ELSE best / 2 END AS c FROM best, (VALUES (0), (1), (2)) k(o)), "
    "sc AS (SELECT cd.track_id, best, o, c, avg(CASE WHEN q BETWEEN 1 AND 4 AND abs(ra - q) / q < CAST(0.05 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT cd.*, x / c AS ra, floor(x / c + 0.5) AS q FROM cd JOIN va USING (track_id)) cd GROUP BY 1, 2, 3, 4), "
    "win AS (SELECT track_id, coalesce(arg_max(c, s * 10 - o) FILTER (c BETWEEN CAST(0.2 AS DOUBLE) AND 2.0 AND s > 0 AND top = s), any_value(best)) AS candidate, coalesce(max(s) FILTER (c BETWEEN CAST(0.2 AS DOUBLE) AND 2.0), 0) AS score FROM "
    "(SELECT *, max(s) FILTER (c BETWEEN CAST(0.2 AS DOUBLE) AND 2.0) OVER (PARTITION BY track_id) AS top FROM sc) GROUP BY 1)"
)


@query("d5_tempo_candidates", b_sql(f"{best_sql(200, 0.2, 2.0, False)}, {CANDIDATES} SELECT track_id, {r('candidate')} AS candidate, {r('score')} AS score FROM win"))
def d5(spark, sf):
    rows = stage(iv(spark, sf), "intervals")
    best = tempo.dominant_interval(rows, low=0.2, high=2.0, bins_per_second=200, for_gaps=False)
    return tempo.tempo_candidates(rows, best).select("track_id", rnd("candidate").alias("candidate"), rnd("score").alias("score"))


BPM = "bpm AS (SELECT track_id, CASE WHEN m > 0 THEN 60.0 / m ELSE 0.0 END AS bpm FROM (SELECT track_id, list_sort(list(x))[count(*) // 2 + 1] AS m FROM iv GROUP BY 1))"
FOLD = "down * CASE WHEN down > 0 AND down < 70 THEN pow(2, ceil(log2(70.0 / down))) ELSE 1 END"
DOWN = "CASE WHEN bpm > 180 THEN bpm / pow(2, ceil(log2(bpm / 180.0))) ELSE bpm END"


@query("d6_median_bpm", b_sql(f"{BPM} SELECT track_id, {r('bpm')} AS bpm FROM bpm"))
def d6(spark, sf):
    return tempo.median_bpm(stage(fx.beats(spark, sf), "beats")).select("track_id", rnd("bpm").alias("bpm"))


@query("d7_octave_fold", b_sql(f"f AS (SELECT track_id, beat_idx, {DOWN} AS down FROM (SELECT *, CASE WHEN x > 0 THEN 60.0 / x ELSE 0.0 END AS bpm FROM iv)) SELECT track_id, beat_idx, {r(FOLD)} AS bpm FROM f"))
def d7(spark, sf):
    return iv(spark, sf).select("track_id", "beat_idx", rnd(tempo.octave_fold(tempo.bpm_from_median(F.col("x")))).alias("bpm"))


SUMMARY = "sm AS (SELECT track_id, count(*) AS n_beats, max(t) AS duration, CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 0 END AS avg_interval FROM beats GROUP BY 1)"


@query("d8_grid_bpm", b_sql(f"{SUMMARY} SELECT track_id, {r('CASE WHEN track_id % 3 = 0 THEN 100.0 + track_id WHEN avg_interval > 0 THEN 60.0 / avg_interval ELSE 0 END')} AS bpm FROM sm"))
def d8(spark, sf):
    b = stage(fx.beats(spark, sf), "beats")
    given = b.select("track_id").distinct().select("track_id", F.when(F.col("track_id") % 3 == 0, 100.0 + F.col("track_id")).otherwise(0.0).alias("bpm"))
    return tempo.grid_summary(b, given).select("track_id", rnd("bpm").alias("bpm"))


@query("d9_regularity", b_sql("mn AS (SELECT track_id, list_sort(list(x))[count(*) // 2 + 1] AS m, count(*) AS n FROM iv GROUP BY 1), "
       "v AS (SELECT track_id, m, n, sqrt(avg((x - m) * (x - m))) AS sd FROM iv JOIN mn USING (track_id) GROUP BY 1, 2, 3) "
       f"SELECT track_id, {r('CASE WHEN n + 1 > 10 THEN greatest(0.0, 1 - sd / m * 2) ELSE 0.0 END')} AS confidence FROM v"))
def d9(spark, sf):
    even = stage(iv(spark, sf), "intervals")
    return tempo.regularity(even).select("track_id", rnd("confidence").alias("confidence"))


@query("d9_regularity_truth_offset", b_sql("o AS (SELECT track_id, 1.0 + x / 50 AS x FROM iv), mn AS (SELECT track_id, list_sort(list(x))[count(*) // 2 + 1] AS m, count(*) AS n FROM o GROUP BY 1), "
       "v AS (SELECT track_id, m, n, sqrt(avg((x - m) * (x - m))) AS sd FROM o JOIN mn USING (track_id) GROUP BY 1, 2, 3) "
       f"SELECT track_id, {r('CASE WHEN n + 1 > 10 THEN greatest(0.0, 1 - sd / m * 2) ELSE 0.0 END')} AS confidence FROM v"))
def d9_even(spark, sf):
    steady = stage(iv(spark, sf).withColumn("x", 1.0 + F.col("x") / 50), "intervals")
    return tempo.regularity(steady).select("track_id", rnd("confidence").alias("confidence"))


@query("d10_filtered_average_interval", b_sql(f"SELECT track_id, {r('coalesce(avg(x) FILTER (x > CAST(0.05 AS DOUBLE) AND x < 5), 1.0)')} AS avg_interval FROM iv GROUP BY 1"))
def d10(spark, sf):
    return tempo.filtered_average_interval(iv(spark, sf), fallback=1.0).select("track_id", rnd("avg_interval").alias("avg_interval"))


@query("d11_grid_summary", b_sql(f"{SUMMARY} SELECT track_id, n_beats, {r('CASE WHEN avg_interval > 0 THEN 60.0 / avg_interval ELSE 0 END')} AS bpm, {r('duration')} AS duration, {r('avg_interval')} AS avg_interval FROM sm"))
def d11(spark, sf):
    s = tempo.grid_summary(fx.beats(spark, sf))
    return s.select("track_id", "n_beats", *[rnd(c).alias(c) for c in ("bpm", "duration", "avg_interval")])


SIV = "siv AS (SELECT * FROM (SELECT track_id, stem, t - lag(t) OVER (PARTITION BY track_id, stem ORDER BY beat_idx) AS x FROM stem_beats) WHERE x IS NOT NULL)"


@query("d14_detector_rollup", with_views("stem_beats", f"WITH {SIV}, mn AS (SELECT track_id, stem, list_sort(list(x))[count(*) // 2 + 1] AS m, count(*) AS n FROM siv GROUP BY 1, 2), "
       "v AS (SELECT track_id, stem, m, n, sqrt(avg((x - m) * (x - m))) AS sd FROM siv JOIN mn USING (track_id, stem) GROUP BY 1, 2, 3, 4) "
       f"SELECT b.track_id, b.stem AS detector, b.n AS n_beats, {r('coalesce(60.0 / m, 0)')} AS bpm, {r('coalesce(CASE WHEN v.n + 1 > 10 THEN greatest(0.0, 1 - sd / m * 2) ELSE 0.0 END, 0)')} AS confidence "
       "FROM (SELECT track_id, stem, count(*) AS n FROM stem_beats GROUP BY 1, 2) b LEFT JOIN v ON v.track_id = b.track_id AND v.stem = b.stem"))
def d14(spark, sf):
    keys = ["track_id", "detector"]
    b = stage(fx.stem_beats(spark, sf).withColumnRenamed("stem", "detector"), "beats")
    out = tempo.detector_rollup(b, tempo.median_bpm(b, keys=keys), tempo.regularity(tempo.intervals(b, keys=keys), keys=keys))
    return out.select("track_id", "detector", "n_beats", rnd("bpm").alias("bpm"), rnd("confidence").alias("confidence"))


# ---- E: grids -----------------------------------------------------------------------------

ANCHOR = "an AS (SELECT b.track_id, min(b.t) AS first_beat, CAST(track_id % 40 * 10 - 20 AS DOUBLE) AS bpm, max(b.t) + 1.0 AS duration FROM beats b GROUP BY 1)"


def anchors(spark, sf):
    e = fx.event_times(spark, sf)
    return e.groupBy("track_id").agg(F.min("t").alias("first_beat"), (F.max("t") + 1.0).alias("duration")).withColumn("bpm", (F.col("track_id") % 40 * 10 - 20).cast("double"))


def even_sql(start, bpm, where):
    return (f"gr AS (SELECT track_id, {start} AS t0, 60.0 / ({bpm}) AS step, duration FROM an WHERE {where}), "
            "ev2 AS (SELECT track_id, t0, step, unnest(range(CAST(greatest(ceil((duration - t0) / step - 1e-9), 0) AS BIGINT))) AS beat_idx FROM gr)")


@query("e1_even_grid", with_views("beats", f"WITH {ANCHOR}, {even_sql('first_beat', 'least(greatest(bpm, 20), 300)', 'bpm > 0')} SELECT track_id, beat_idx, {r('t0 + beat_idx * step')} AS t FROM ev2"))
def e1(spark, sf):
    return grid.even_grid(anchors(spark, sf)).select("track_id", "beat_idx", rnd("t").alias("t"))


@query("e2_regrid", with_views("beats", f"WITH {ANCHOR}, an2 AS (SELECT track_id, first_beat + track_id % 2 * 100 AS first_beat, bpm, duration FROM an), "
       + even_sql("CASE WHEN first_beat >= duration THEN 0.0 ELSE first_beat END", "bpm", "bpm BETWEEN 20 AND 300").replace("FROM an ", "FROM an2 ")
       + f" SELECT track_id, beat_idx, {r('t0 + beat_idx * step')} AS t FROM ev2"))
def e2(spark, sf):
    late = anchors(spark, sf).withColumn("first_beat", F.col("first_beat") + F.col("track_id") % 2 * 100)
    return grid.regrid(late).select("track_id", "beat_idx", rnd("t").alias("t"))


@query("e3_halve_double", with_views("beats", f"WITH {SUMMARY.replace('sm AS', 'sm AS')} SELECT track_id, {r('CASE WHEN track_id % 2 = 0 THEN CASE WHEN bpm > 40 THEN bpm / 2 END WHEN bpm > 0 AND bpm < 150 THEN bpm * 2 END')} AS bpm "
       "FROM (SELECT track_id, 60.0 / avg_interval + track_id % 7 * 10 - 90 AS bpm FROM sm)"))
def e3(spark, sf):
    s = tempo.grid_summary(fx.beats(spark, sf)).withColumn("bpm", F.col("bpm") + F.col("track_id") % 7 * 10 - 90)
    action = F.when(F.col("track_id") % 2 == 0, "half").otherwise("double")
    return s.select("track_id", rnd(grid.halve_or_double(F.col("bpm"), action)).alias("bpm"))


@query("e4_reanalysis_override", with_views("beats", f"WITH {ANCHOR}, {even_sql('first_beat', 'bpm', 'track_id % 3 > 0 AND bpm BETWEEN 20 AND 300 AND abs(bpm - 120) > 0.5')} "
       f"SELECT track_id, beat_idx, {r('t0 + beat_idx * step')} AS t FROM ev2 UNION ALL SELECT track_id, beat_idx, {r('t')} FROM beats WHERE track_id NOT IN (SELECT track_id FROM gr)"))
def e4(spark, sf):
    req = anchors(spark, sf).select("track_id", (F.col("track_id") % 3 > 0).alias("analysed"), F.col("bpm").alias("user_bpm"), F.lit(120.0).alias("detected_bpm"), "duration")
    out = grid.reanalysis_override(stage(fx.beats(spark, sf), "beats"), req)
    return out.select("track_id", "beat_idx", rnd("t").alias("t"))


@query("e5_gap_fill", with_views("beats tracks", f"WITH {IV}, {best_sql(100, 0.15, 1.5, True)}, "
       "pl AS (SELECT track_id, best AS u, min(t) AS f, max(t) AS l, any_value(duration) AS d FROM best JOIN beats USING (track_id) JOIN tracks USING (track_id) GROUP BY 1, 2 HAVING count(*) >= 4), "
       "gp AS (SELECT track_id, t, nx - t AS g, CAST(floor((nx - t) / u + 0.5) AS BIGINT) - 1 AS m FROM (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY beat_idx) AS nx FROM beats) JOIN pl USING (track_id) WHERE nx - t > u * 1.5), "
       "fl AS (SELECT track_id, t + j * (g / (m + 1)) AS t FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM gp WHERE m > 0 AND m < 8) "
       "UNION ALL SELECT track_id, f - j * u FROM (SELECT *, unnest(range(1, CAST(ceil((f - CAST(0.1 AS DOUBLE)) / u - 1e-9) AS BIGINT))) AS j FROM pl WHERE f > u * 1.5) "
       "UNION ALL SELECT track_id, l + j * u FROM (SELECT *, unnest(range(1, CAST(ceil((d - CAST(0.1 AS DOUBLE) - l) / u - 1e-9) AS BIGINT))) AS j FROM pl WHERE u >= CAST(0.1 AS DOUBLE))) "
       f"SELECT track_id, {r('t')} AS t, false AS filled FROM beats UNION ALL SELECT track_id, {r('t')}, true FROM fl"))
def e5(spark, sf):
    filled = grid.fill_gaps(stage(fx.beats(spark, sf), "beats"), fx.tracks(spark, sf))
    return filled.select("track_id", rnd("t").alias("t"), "filled")


def additions(spark, sf):
    """One added beat per order: its track, with times that may fall outside the track."""
    return fx.regions(spark, sf).select("track_id", F.col("region_id").alias("edit_id"), (F.col("end_s") * 1.25 - 3.0).alias("t"))


@query("e6_add_beats", with_views("beats regions tracks", "WITH al AS (SELECT track_id, t, 0 AS src, beat_idx AS n FROM beats UNION ALL SELECT track_id, end_s * 1.25 - 3.0, 1, region_id FROM regions JOIN tracks USING (track_id) WHERE end_s * 1.25 - 3.0 BETWEEN 0 AND duration) "
       f"SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, src, n) - 1 AS beat_idx, {r('t')} AS t, src = 1 AS added FROM al"))
def e6(spark, sf):
    return grid.add_beats(fx.beats(spark, sf), additions(spark, sf), fx.tracks(spark, sf)).select("track_id", "beat_idx", rnd("t").alias("t"), "added")


@query("e7_remove_nearest", with_views("beats regions", "WITH ed AS (SELECT track_id, region_id, start_s * 1.1 AS t FROM regions), "
       "hit AS (SELECT DISTINCT track_id, beat_idx FROM (SELECT ed.track_id, region_id, beat_idx, row_number() OVER (PARTITION BY region_id ORDER BY abs(b.t - ed.t), beat_idx) AS rn FROM ed JOIN beats b ON b.track_id = ed.track_id AND abs(b.t - ed.t) < CAST(0.05 AS DOUBLE)) WHERE rn = 1) "
       f"SELECT track_id, beat_idx, {r('t')} AS t FROM beats WHERE (track_id, beat_idx) NOT IN (SELECT track_id, beat_idx FROM hit)"))
def e7(spark, sf):
    edits = fx.regions(spark, sf).select("track_id", F.col("region_id").alias("edit_id"), (F.col("start_s") * F.lit(1.1)).alias("t"))
    return grid.remove_nearest(stage(fx.beats(spark, sf), "beats"), edits).select("track_id", "beat_idx", rnd("t").alias("t"))


@query("e8_move_beats", with_views("beats regions tracks", "WITH ed AS (SELECT track_id, region_id % 97 AS beat_idx, max(end_s * 1.2 - 2) AS nt FROM regions GROUP BY 1, 2) "
       f"SELECT track_id, beat_idx, {r('coalesce(least(greatest(nt, 0.0), duration), t)')} AS t FROM beats JOIN tracks USING (track_id) LEFT JOIN ed USING (track_id, beat_idx)"))
def e8(spark, sf):
    edits = fx.regions(spark, sf).groupBy("track_id", (F.col("region_id") % 97).alias("beat_idx")).agg(F.max(F.col("end_s") * F.lit(1.2) - 2).alias("new_t"))
    return grid.move_beats(fx.beats(spark, sf), edits, fx.tracks(spark, sf)).select("track_id", "beat_idx", rnd("t").alias("t"))


RANK = {"signup": 0, "purchase": 1, "click": 2}


@query("e9_detector_fallback", with_views("ev", "WITH d AS (SELECT track_id, t, CASE WHEN stem = 'signup' AND value <= 80 THEN 'view' ELSE stem END AS stem FROM ev), k AS (SELECT track_id, stem, t, CASE stem WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 END AS k FROM d WHERE stem IN ('signup', 'purchase', 'click')) "
       f"SELECT track_id, detector, {r('t')} AS t FROM (SELECT track_id, stem AS detector, t, k, min(k) OVER (PARTITION BY track_id) AS best FROM k) WHERE k = best"))
def e9(spark, sf):
    weak = (F.col("stem") == "signup") & (F.col("value") <= 80)
    found = fx.event_times(spark, sf).withColumn("detector", F.when(weak, "view").otherwise(F.col("stem")))
    return grid.detector_fallback(found, RANK).select("track_id", "detector", rnd("t").alias("t"))


@query("e10_stem_fallback", with_views("stem_beats", "WITH has AS (SELECT DISTINCT track_id FROM stem_beats WHERE stem = 'view' AND beat_idx > 12) "
       f"SELECT track_id, 'drums' AS origin, beat_idx AS idx, {r('t')} AS v FROM stem_beats WHERE stem = 'view' AND track_id IN (SELECT * FROM has) "
       f"UNION ALL SELECT track_id, 'mix', beat_idx, {r('t')} FROM (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS beat_idx, t FROM ev) WHERE track_id NOT IN (SELECT * FROM has)"))
def e10(spark, sf):
    stems = stage(fx.stem_beats(spark, sf), "stems")
    rich = stems.filter("stem = 'view' AND beat_idx > 12").select("track_id").distinct()
    drums = stems.filter("stem = 'view'").join(rich, "track_id", "left_semi").select("track_id", F.lit("drums").alias("stem"), F.col("beat_idx").alias("idx"), F.col("t").alias("v"))
    mix = fx.beats(spark, sf).select("track_id", F.col("beat_idx").alias("idx"), F.col("t").alias("v"))
    return grid.stem_fallback(drums, mix).select("track_id", "origin", "idx", rnd("v").alias("v"))
