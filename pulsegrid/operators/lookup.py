"""Lookups: as-of, interval, equality and anti joins on timelines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.carry import Run, carry_scan
from pulsegrid.operators.sequence import TRACK, neighbours, ordered_prefix

RADIX_BITS = 2
FAR = 2.0**52  # no beat has this number
LABELS = [  # fixed values: class order of the label head
    "intro", "verse", "pre-chorus", "chorus", "post-chorus", "bridge", "outro", "instrumental", "solo", "silence",
]


def _marks(df: DataFrame, keys: Sequence[str], at: str, kind: int, ident: str, weight: int) -> DataFrame:
    return df.select(
        *keys, F.col(at).alias("_t"), F.lit(kind).alias("_kind"), F.col(ident).cast("long").alias("_id"), F.lit(weight).cast("long").alias("_w")
    )


def beats_before(
    probes: DataFrame, beats: DataFrame, *, probe_id: str, keys: Sequence[str] = TRACK, inclusive: bool = False, partitions: int | None = None
) -> DataFrame:
    """(keys, probe_id, t, rank): number of beats before each probe (``inclusive``: at or before)."""
    probe_kind = 2 if inclusive else 0
    marks = _marks(probes, keys, "t", probe_kind, probe_id, 0).unionByName(_marks(beats, keys, "t", 1, "beat_idx", 1))
    ranked = ordered_prefix(marks, keys, ["_t", "_kind", "_id"], {"rank": F.col("_w")}, partitions=partitions)
    return ranked.filter(F.col("_kind") == probe_kind).select(*keys, F.col("_id").alias(probe_id), F.col("_t").alias("t"), "rank")


def beat_pairs(beats: DataFrame, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """For each rank the beat just before it and the beat at it."""
    ahead = neighbours(beats.select(*keys, "beat_idx", "t"), keys, "beat_idx", lambda w: {"next_t": F.lead("t").over(w)})
    inner = ahead.select(*keys, (F.col("beat_idx") + 1).alias("rank"), F.col("t").alias("prev_t"), "next_t")
    first = beats.filter("beat_idx = 0").select(*keys, F.lit(0).cast("long").alias("rank"), F.lit(None).cast("double").alias("prev_t"), F.col("t").alias("next_t"))
    return inner.unionByName(first)


def nearest_beat(
    probes: DataFrame, beats: DataFrame, *, probe_id: str = "probe_id", keys: Sequence[str] = TRACK, tie: str = "later", partitions: int | None = None
) -> DataFrame:
    """nearest beat of each probe; a tie goes to the later beat (``tie='earlier'`` for edits).

    Probes learn how many beats precede them from one range sort of both sides, then meet
    the two surrounding beats by equality on (track, rank): no row pairs are generated.
    """
    ranked = beats_before(probes, beats, probe_id=probe_id, keys=keys, partitions=partitions)
    joined = ranked.join(beat_pairs(beats, keys=keys), [*keys, "rank"], "left")
    to_prev, to_next = F.col("t") - F.col("prev_t"), F.col("next_t") - F.col("t")
    closer = to_prev < to_next if tie == "later" else to_prev <= to_next
    use_prev = F.col("next_t").isNull() | F.coalesce(closer, F.lit(False))
    idx = F.when(F.col("prev_t").isNull() & F.col("next_t").isNull(), None).when(use_prev, F.col("rank") - 1).otherwise(F.col("rank"))
    return joined.select(
        *keys, probe_id, "t",
        idx.alias("nearest_idx"),
        F.coalesce(F.when(use_prev, F.col("prev_t")).otherwise(F.col("next_t")), F.lit(0.0)).alias("nearest_t"),
        F.when(use_prev, to_prev).otherwise(to_next).alias("distance"),
    )


def beat_at(requests: DataFrame, beats: DataFrame) -> DataFrame:
    """time of the i-th beat, 0 when out of range."""
    return requests.join(beats.select("track_id", "beat_idx", "t"), ["track_id", "beat_idx"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))


def beat_near(probes: DataFrame, beats: DataFrame, tolerance: Column, *, probe_id: str = "probe_id") -> DataFrame:
    """index of the closest beat strictly within ``tolerance``, else -1.

    ``tolerance`` is a column expression over the probe's other columns.
    """
    near = nearest_beat(probes, beats, probe_id=probe_id, tie="earlier")
    rest = probes.drop("t")
    joined = near.join(rest, ["track_id", probe_id])
    hit = F.coalesce(F.col("distance") < tolerance, F.lit(False))
    return joined.select("track_id", probe_id, "t", F.when(hit, F.col("nearest_idx")).otherwise(F.lit(-1)).cast("long").alias("beat_idx"))


def _cover(levels: int) -> Column:
    """Aligned blocks of 4^level stretches that tile [lo, hi) exactly; at most six per level."""
    step = 1 << RADIX_BITS
    lo, hi = F.col("_lo"), F.col("_hi")
    blocks = []
    for level in range(levels):
        up = F.ceil(lo / F.lit(float(step))).cast("long")
        down = F.floor(hi / F.lit(float(step))).cast("long")

        def run(a: Column, b: Column, level: int = level) -> Column:
            nodes = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

        if level == levels - 1:
            blocks.append(run(lo, hi))
            break
        split = up < down
        blocks.append(F.when(split, F.concat(run(lo, up * step), run(down * step, hi))).otherwise(run(lo, hi)))
        lo, hi = F.when(split, up).otherwise(F.lit(0).cast("long")), F.when(split, down).otherwise(F.lit(0).cast("long"))
    return F.flatten(F.array(*blocks))


def last_region_at(
    probes: DataFrame, regions: DataFrame, *, probe_id: str = "probe_id", region_id: str = "region_id", partitions: int | None = None
) -> DataFrame:
    """the last region (highest id) whose closed interval contains the probe, else -1.

    Region borders cut a track into elementary stretches on which the answer is constant.
    Equal spans and equal borders are merged first; one range sort of borders and probes
    gives every probe its stretch and every span a range of stretches. A range is tiled by a
    few aligned blocks, a block keeps only its highest region, and a stretch asks the blocks
    above it. Probe-region pairs are never generated, however much the regions overlap.
    """
    keys = list(TRACK)
    spans = regions.filter("start_s <= end_s").groupBy(*keys, "start_s", "end_s").agg(F.max(region_id).cast("long").alias("_region"))
    opening = spans.select(*keys, F.col("start_s").alias("_t"), F.lit(0).alias("_kind"))
    closing = spans.select(*keys, F.col("end_s").alias("_t"), F.lit(2).alias("_kind"))
    borders = opening.unionByName(closing).groupBy(*keys, "_t", "_kind").agg(F.lit(0).cast("long").alias("_id"), F.lit(1).cast("long").alias("_w"))
    marks = borders.unionByName(_marks(probes, keys, "t", 1, probe_id, 0))
    ranked = ordered_prefix(marks, keys, ["_t", "_kind", "_id"], {"rank": F.col("_w")}, partitions=partitions)
    edges = ranked.filter("_kind <> 1")
    top = edges.agg(F.max("rank")).first()[0] or 0
    levels = 1
    while (1 << (RADIX_BITS * levels)) <= top + 1:
        levels += 1
    lo = edges.filter("_kind = 0").select(*keys, F.col("_t").alias("start_s"), (F.col("rank") + 1).alias("_lo"))
    hi = edges.filter("_kind = 2").select(*keys, F.col("_t").alias("end_s"), (F.col("rank") + 1).alias("_hi"))
    bounds = spans.join(lo, [*keys, "start_s"]).join(hi, [*keys, "end_s"])
    nodes = (
        bounds.filter("_hi > _lo").withColumn("_n", F.explode(_cover(levels)))
        .groupBy(*keys, F.col("_n.level").alias("level"), F.col("_n.node").alias("node")).agg(F.max("_region").alias("region"))
    )
    placed = ranked.filter("_kind = 1").select(*keys, F.col("_id").alias(probe_id), F.col("_t").alias("t"), F.col("rank").alias("stretch"))
    ladder = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("stretch", RADIX_BITS * k).alias("node")) for k in range(levels)])
    asked = placed.groupBy(*keys, "stretch").agg(F.lit(1).alias("_one")).select(*keys, "stretch", F.explode(ladder).alias("_n"))
    asked = asked.select(*keys, "stretch", F.col("_n.level").alias("level"), F.col("_n.node").alias("node"))
    answers = asked.join(nodes, [*keys, "level", "node"]).groupBy(*keys, "stretch").agg(F.max("region").alias("region"))
    found = placed.join(answers, [*keys, "stretch"], "left")
    return found.select(*keys, probe_id, "t", F.coalesce("region", F.lit(-1)).cast("long").alias(region_id))


def inside_beat_window(probes: DataFrame, beats: DataFrame, *, width: float, probe_id: str = "probe_id") -> DataFrame:
    """is the probe within ``width`` seconds after a beat, both ends included?

    All windows have one width, so the latest beat at or before the probe decides.
    """
    ranked = beats_before(probes, beats, probe_id=probe_id, inclusive=True)
    last = beats.select("track_id", (F.col("beat_idx") + 1).alias("rank"), F.col("t").alias("_b"))
    joined = ranked.join(last, ["track_id", "rank"], "left")
    return joined.select("track_id", probe_id, "t", F.coalesce(F.col("t") <= F.col("_b") + F.lit(width), F.lit(False)).alias("active"))


def _reach(tolerance: float):
    """The smallest and largest e with abs(t - e) <= tolerance, exactly as that test rounds."""

    def settle(t: np.ndarray, sign: int) -> np.ndarray:
        inside, outside = t + sign * (tolerance - 1e-9), t + sign * (tolerance + 1e-9)
        while True:
            middle = (inside + outside) / 2
            if ((middle == inside) | (middle == outside)).all():
                return inside
            ok = np.abs(t - middle) <= tolerance
            inside, outside = np.where(ok, middle, inside), np.where(ok, outside, middle)

    @F.pandas_udf("first double, last double")
    def edges(t: pd.Series) -> pd.DataFrame:
        values = t.to_numpy(dtype=float)
        return pd.DataFrame({"first": settle(values, -1), "last": settle(values, 1)})

    return edges


def held_between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each detection the interval that holds p, less the number of detections up to there, whatever p was before the first.

    One detection holds it between ``a`` and ``b - 1``, less those before. An earlier interval followed by a later one is
    the earlier one's ends moved into the later, so each round doubles the run of detections that an interval stands for.
    """
    before = np.arange(len(a))
    high = b.astype(np.int64) - before - 1
    low = np.minimum(a.astype(np.int64) - before, high)
    step = 1
    while step < len(a):
        low[step:], high[step:] = np.clip(low[:-step], low[step:], high[step:]), np.clip(high[:-step], low[step:], high[step:])
        step *= 2
    return low, high


def match_truth(
    detected: DataFrame, expected: DataFrame, *, tolerance: float = 0.05, chunk: int = 8192, partitions: int | None = None
) -> DataFrame:
    """each detected beat claims the first unclaimed expected beat within ``tolerance``.

    One range sort of both sides gives every detection the numbers a and b of expected beats before and up to the end of
    its window. Both sides are in time order, so the only state is p, the next expected beat still free: p rises to a, and
    if it is below b the beat p is claimed. As b never falls, p never passes it, so a detection maps p to p + 1 held
    between a + 1 and b. Less one for each detection so far these are plain intervals, which compose to intervals: a chunk
    is two numbers, and all states inside it follow from doubling.
    """
    edges = detected.select("track_id", "beat_idx", _reach(tolerance)("t").alias("w"))
    marks = (
        _marks(edges.withColumn("e", F.col("w.first")), TRACK, "e", 0, "beat_idx", 0)
        .unionByName(_marks(expected, TRACK, "t", 1, "truth_idx", 1))
        .unionByName(_marks(edges.withColumn("e", F.col("w.last")), TRACK, "e", 2, "beat_idx", 0))
    )
    ranked = ordered_prefix(marks, TRACK, ["_t", "_kind", "_id"], {"rank": F.col("_w")}, partitions=partitions)
    rows = ranked.filter("_kind <> 1").groupBy("track_id", F.col("_id").alias("beat_idx")).agg(
        F.max(F.when(F.col("_kind") == 0, F.col("rank"))).alias("a"), F.max(F.when(F.col("_kind") == 2, F.col("rank"))).alias("b")
    )
    rows = rows.withColumn("_chunk", F.expr(f"beat_idx div {chunk}"))

    def summarise(run: Run) -> list[tuple[float, float]]:
        low, high = held_between(run["a"], run["b"])
        a, b, n = float(low[-1]), float(high[-1]), float(len(low))
        return [(a, a + n), *([(b, b + n)] if a < b else []), (FAR, b + n)]

    def emit(run: Run, entry: float) -> Run:
        a, b = run["a"], run["b"]
        low, high = held_between(a, b)
        after = np.clip(int(entry), low, high) + np.arange(1, len(a) + 1)
        free = np.maximum(np.concatenate([[int(entry)], after[:-1]]), a)
        claims = free < b
        return {"beat_idx": run["beat_idx"][claims], "truth_idx": free[claims]}

    out = T.StructType([T.StructField("beat_idx", T.LongType()), T.StructField("truth_idx", T.LongType())])
    return carry_scan(rows, TRACK, order=["beat_idx"], initial=0.0, summarise=summarise, emit=emit, schema=out, linear=True)


def match_scores(detected: DataFrame, expected: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 per track."""
    counts = (
        detected.groupBy("track_id").agg(F.count(F.lit(1)).alias("detected"))
        .join(expected.groupBy("track_id").agg(F.count(F.lit(1)).alias("expected")), "track_id", "full")
        .join(matches.groupBy("track_id").agg(F.count(F.lit(1)).alias("matched")), "track_id", "left")
        .na.fill(0)
    )
    p, q = F.col("matched") / F.col("detected"), F.col("matched") / F.col("expected")
    return counts.select(
        "track_id", "detected", "expected", "matched",
        F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(q, F.lit(0.0)).alias("recall"),
        F.coalesce(F.lit(2.0) * F.col("matched") / (F.col("detected") + F.col("expected")), F.lit(0.0)).alias("f1"),
    )


def segment_labels(segments: DataFrame, scores: DataFrame, lengths: DataFrame, *, rate: float) -> DataFrame:
    """class with the highest score at the segment's first frame, first class on ties.

    ``scores(track_id, frame_idx, x)``; ``lengths(track_id, n_frames)`` clamps the frame.
    """
    frame = F.least(F.greatest(F.floor(F.col("start_s") * F.lit(rate)), F.lit(0)), F.col("n_frames") - 1).cast("long")
    at = segments.join(lengths, "track_id").withColumn("frame_idx", frame)
    head = F.slice("x", 1, len(LABELS))
    best = F.array_max(head)
    names = F.array(*[F.lit(name) for name in LABELS])
    return at.join(scores, ["track_id", "frame_idx"]).select(
        "track_id", "seg_idx", "start_s", "end_s",
        F.element_at(names, F.array_position(head, best).cast("int")).alias("label"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-best))).alias("confidence"),
    )


def resolve_transition(requests: DataFrame, catalog: DataFrame, *, fallback: str = "fade") -> DataFrame:
    """F8: by name or by path, else the fallback, else null.

    The catalogue is joined as is; Spark broadcasts it when its measured size allows.
    """
    entries = catalog.select("name", "path")
    keys = entries.select(F.col("name").alias("wanted"), "name").unionByName(entries.select(F.col("path").alias("wanted"), "name"))
    lookup = keys.groupBy("wanted").agg(F.min("name").alias("found"))
    spare = None if entries.filter(F.col("name") == fallback).isEmpty() else fallback
    joined = requests.join(lookup, "wanted", "left")
    return joined.withColumn("resolved", F.coalesce("found", F.lit(spare).cast("string"))).drop("found")


def missing_files(segments: DataFrame, files: DataFrame) -> DataFrame:
    """segments whose file is not in the listing."""
    return segments.join(files.select("path").distinct(), "path", "left_anti")


def stem_effects(stem_beats: DataFrame, config: DataFrame) -> DataFrame:
    """beats of enabled stems with their effect; stems without beats drop out by the join."""
    active = config.filter(F.col("enabled") & (F.col("effect") != "None"))
    return stem_beats.join(active.select("stem", "effect"), "stem")
