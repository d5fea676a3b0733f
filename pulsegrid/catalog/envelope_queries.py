"""Queries for the C family: envelopes and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.registry import query
from pulsegrid.catalog.signal_queries import ENERGY, FX, framed, spec
from pulsegrid.catalog.views import r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import envelope, onset, signal
from pulsegrid.operators.carry import minimum_gap
from pulsegrid.session import stage
from pulsegrid.sources import fixtures as fx

W = "(PARTITION BY track_id ORDER BY frame_idx"
P = "(PARTITION BY track_id)"


def energy(spark, sf):
    return signal.frame_energy(fx.samples(spark, sf), length=6, hop=3)


def rows(df, *names, digits=8):
    return df.select("track_id", "frame_idx", *[rnd(n, digits).alias(n) for n in names])


SMOOTH = f"smooth AS (SELECT track_id, frame_idx, CASE WHEN count(*) OVER {P} < 5 THEN v ELSE avg(v) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS s FROM energy)"


def e_sql(body):
    return with_views("samples", f"WITH {ENERGY}, {body}")


@query("c1_moving_average", e_sql(f"{SMOOTH} SELECT track_id, frame_idx, {r('s', 8)} AS s FROM smooth"))
def c1(spark, sf):
    return rows(envelope.moving_average(energy(spark, sf)), "s")


def gauss_sql(sigma, radius, src, out="gs"):
    return (
        f"k AS (SELECT k, exp(-0.5 * k * k / ({sigma} * {sigma})) / (SELECT sum(exp(-0.5 * j * j / ({sigma} * {sigma}))) FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS j)) AS w "
        f"FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS k)), "
        f"{out} AS (SELECT a.track_id, a.frame_idx, sum(b.v * w) AS s FROM (SELECT *, max(frame_idx) OVER {P} AS last FROM {src}) a, k, {src} b "
        "WHERE b.track_id = a.track_id AND b.frame_idx = least(greatest(a.frame_idx + k, 0), last) GROUP BY 1, 2)"
    )


@query("c2_gaussian_smooth", e_sql(f"{gauss_sql('CAST(1.5 AS DOUBLE)', 5, 'energy')} SELECT track_id, frame_idx, {r('s', 8)} AS s FROM gs"))
def c2(spark, sf):
    return rows(envelope.gaussian_smooth(energy(spark, sf), sigma=1.5), "s")


FLUX = "flux AS (SELECT track_id, frame_idx, sum(greatest(d, 0)) AS v FROM (SELECT track_id, frame_idx, mag - coalesce(lag(mag) OVER (PARTITION BY track_id, bin ORDER BY frame_idx), 0) AS d FROM spec) GROUP BY 1, 2)"
FRAME_FLUX = f"{FX}, {spec('sqrt({p})')}, {FLUX}"


@query("c3_spectral_flux", with_views("frames", f"WITH {FRAME_FLUX} SELECT track_id, frame_idx, {r('v')} AS v FROM flux"))
def c3(spark, sf):
    return rows(envelope.spectral_flux(signal.spectrum(fx.frames(spark, sf))), "v", digits=6)


@query("c4_max_normalise", e_sql(f"o AS (SELECT track_id, frame_idx, v / max(v) OVER {P} AS v FROM energy) SELECT track_id, frame_idx, {r('v')} AS v FROM o"))
def c4(spark, sf):
    return rows(envelope.max_normalise(energy(spark, sf)), "v", digits=6)


@query("c5_z_normalise", e_sql(f"o AS (SELECT track_id, frame_idx, (v - avg(v) OVER {P}) / (coalesce(stddev_samp(v) OVER {P}, 0) + 1e-9) AS v FROM energy) SELECT track_id, frame_idx, {r('v')} AS v FROM o"))
def c5(spark, sf):
    return rows(envelope.z_normalise(energy(spark, sf)), "v", digits=6)


@query("c6_energy_threshold", e_sql(f"{SMOOTH} SELECT track_id, {r('avg(s) + (1 - 2 * CAST(0.3 AS DOUBLE)) * stddev_pop(s)', 8)} AS threshold FROM smooth GROUP BY 1"))
def c6(spark, sf):
    smooth = envelope.moving_average(energy(spark, sf))
    return envelope.energy_threshold(smooth, sensitivity=0.3).select("track_id", rnd("threshold", 8).alias("threshold"))


IQR = (
    "q AS (SELECT track_id, list_sort(list(v)) AS l, count(*) AS n, max(v) AS mx, avg(v) AS mean FROM {src} GROUP BY 1), "
    "thr AS (SELECT track_id, least(greatest(CASE WHEN n < 4 THEN greatest(mean, mx * CAST(0.12 AS DOUBLE)) ELSE p25 + 0.5 * (p75 - p25) END, mx * CAST(0.08 AS DOUBLE)), mx * CAST(0.25 AS DOUBLE)) AS threshold "
    "FROM (SELECT *, l[CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT) + 1] AS p25, l[CAST(floor(n * CAST(0.75 AS DOUBLE)) AS BIGINT) + 1] AS p75 FROM q))"
)


@query("c7_iqr_threshold", e_sql(f"{IQR.format(src='energy')} SELECT track_id, {r('threshold', 8)} AS threshold FROM thr"))
def c7(spark, sf):
    return envelope.iqr_threshold(energy(spark, sf)).select("track_id", rnd("threshold", 8).alias("threshold"))


@query("c8_local_threshold", e_sql(f"o AS (SELECT track_id, frame_idx, greatest(avg(greatest(v, 0)) OVER {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) * CAST(1.2 AS DOUBLE), CAST(0.01 AS DOUBLE)) AS threshold FROM energy) "
       f"SELECT track_id, frame_idx, {r('threshold', 8)} AS threshold FROM o"))
def c8(spark, sf):
    return rows(envelope.local_threshold(energy(spark, sf), factor=1.2, value="v"), "threshold")


RULES = {"strict": "v > l AND v > r", "flat_right": "v > l AND v >= r", "flat_left": "v >= l AND v > r"}


def c9_sql(rule):
    return with_views("ev", f"WITH e AS (SELECT event_type AS track_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame_idx, floor(value / 10) AS v FROM events), "
                      f"o AS (SELECT *, lag(v) OVER {W}) AS l, lead(v) OVER {W}) AS r FROM e) SELECT track_id, frame_idx, coalesce({RULES[rule]}, false) AS is_peak FROM o")


def _c9(rule):
    @query(f"c9_local_maximum_{rule}", c9_sql(rule))
    def run(spark, sf):
        steps = fx.samples(spark, sf).select("track_id", F.col("idx").alias("frame_idx"), F.floor((F.col("v") * 500 + 50 + 1e-9) / 10).alias("v"))
        return envelope.local_maximum(steps, rule=rule).select("track_id", "frame_idx", "is_peak")

    return run


for _rule in RULES:
    _c9(_rule)


def greedy_sql(cand, at, gap, start=None):
    """Candidates in table ``cand`` (track_id, frame_idx), kept by recursion over the next allowed one."""
    first = f"WHERE {at} - {start} >= {gap}" if start is not None else ""
    return (
        f"nx AS (SELECT a.track_id, a.frame_idx, min(b.frame_idx) AS nxt FROM {cand} a LEFT JOIN {cand} b ON a.track_id = b.track_id AND b.frame_idx > a.frame_idx AND b.{at} - a.{at} >= {gap} GROUP BY 1, 2), "
        f"kept(track_id, frame_idx) AS (SELECT track_id, min(frame_idx) FROM {cand} {first} GROUP BY 1 UNION ALL SELECT nx.track_id, nx.nxt FROM kept JOIN nx ON nx.track_id = kept.track_id AND nx.frame_idx = kept.frame_idx WHERE nx.nxt IS NOT NULL)"
    )


CAND = f"mk AS (SELECT *, lag(s) OVER {W}) AS l, lead(s) OVER {W}) AS r, avg(s) OVER {P} AS thr FROM smooth), cand AS (SELECT track_id, frame_idx, frame_idx AS pos FROM mk WHERE s > l AND s > r AND s > thr)"


@query("c10_minimum_gap", with_views("samples", f"WITH {ENERGY}, {SMOOTH}, {CAND}, {greedy_sql('cand', 'pos', 18, 0)} SELECT track_id, frame_idx FROM kept", recursive=True))
def c10(spark, sf):
    marked = stage(envelope.smooth_and_mark(energy(spark, sf)), "marked")
    limit = envelope.energy_threshold(marked, sensitivity=0.5)
    loud = marked.filter("is_peak").join(limit, "track_id").filter("s > threshold").withColumn("at", F.col("frame_idx").cast("double"))
    return minimum_gap(loud, ["track_id"], "frame_idx", "at", 18.0, reach=18, initial=0.0).select("track_id", "frame_idx")


# The onset envelope of the 200 Hz signal, normalised, with IQR-threshold peaks 12 frames apart
ONSET_ENV = (
    framed(32, 8, "full") + ", fr AS (SELECT track_id, frame_idx, pos AS n, v FROM framed), " + spec("sqrt({p})", "17", 32, "fr", "CAST(0.5 AS DOUBLE) * (1 - cos(2 * pi() * n / 31))")
    + f", {FLUX}, env AS (SELECT track_id, frame_idx, v / max(v) OVER {P} AS v FROM flux), {IQR.format(src='env')}, "
    f"om AS (SELECT *, lag(v) OVER {W}) AS l, lead(v) OVER {W}) AS r FROM env), om2 AS (SELECT om.*, threshold FROM om JOIN thr USING (track_id) WHERE v > l AND v >= r), "
    "cand AS (SELECT track_id, frame_idx, frame_idx AS pos FROM om2 WHERE v > threshold)"
)
RESCUE = (
    "pk AS (SELECT *, lead(frame_idx) OVER (PARTITION BY track_id ORDER BY frame_idx) AS nf, count(*) OVER (PARTITION BY track_id) AS n FROM kept), "
    "gp AS (SELECT track_id, frame_idx AS f0, frame_idx + {g} AS lo, nf - {g} AS hi FROM (SELECT *, avg(nf - frame_idx) OVER (PARTITION BY track_id) AS mean FROM pk) WHERE n > 4 AND nf - frame_idx > mean * CAST(1.8 AS DOUBLE)), "
    "add AS (SELECT track_id, frame_idx FROM (SELECT m.track_id, m.frame_idx, row_number() OVER (PARTITION BY m.track_id, f0 ORDER BY v DESC, m.frame_idx) AS rn "
    "FROM om2 m JOIN gp ON gp.track_id = m.track_id AND m.frame_idx >= lo AND m.frame_idx < hi WHERE v > threshold * 0.5) WHERE rn = 1), "
    "allp AS (SELECT track_id, frame_idx FROM kept UNION ALL SELECT track_id, frame_idx FROM add)"
)


@query("c11_gap_rescue", with_views("samples", f"WITH {ONSET_ENV}, {greedy_sql('cand', 'pos', 12)}, {RESCUE.format(g=3)} SELECT track_id, frame_idx FROM allp", recursive=True))
def c11(spark, sf):
    flux = envelope.spectral_flux(signal.stft(fx.samples(spark, sf), length=32, hop=8))
    env = stage(envelope.local_maximum(envelope.max_normalise(flux), rule="flat_right"), "env")
    limits = stage(envelope.iqr_threshold(env), "limits")
    loud = env.filter("is_peak").join(limits, "track_id").filter("v > threshold").withColumn("at", F.col("frame_idx").cast("double"))
    kept = stage(minimum_gap(loud, ["track_id"], "frame_idx", "at", 12.0, reach=12), "kept")
    return onset.rescue_gaps(env, kept, limits, min_gap=3).select("track_id", "frame_idx")
