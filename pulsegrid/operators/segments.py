"""Segmentation of timelines: cuts, gaps, clip assignment, overlap-add, filter text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.rounding import printf
from pulsegrid.operators.carry import NONE, Run, carry_scan
from pulsegrid.operators.sequence import TRACK, counted, dense_index, neighbours, running_sum, with_stats
from pulsegrid.operators.tempo import filtered_average_interval
from pulsegrid.session import new_path, stage
from pulsegrid.sources import files

DEFAULT_CLIP = 30.0  # fixed: length assumed for a clip of unknown duration
MIN_SEGMENT = 0.1
LONG_GAP = 3.0
TIE = 1e-6
PER_CHUNK = 30  # fixed: beats per filter expression
COLOR_FILTERS = {  # fixed values: filter text per colour preset
    "warm": "colorbalance=rs=0.1:gs=0.05:bs=-0.05",
    "cool": "colorbalance=rs=-0.05:gs=0.0:bs=0.1",
    "vintage": "colorchannelmixer=.393:.769:.189:0:.349:.686:.168:0:.272:.534:.131",
    "vibrant": "eq=saturation=1.4:contrast=1.1",
}


def cut_at_beats(beats: DataFrame, *, clip: Column | None = None) -> DataFrame:
    """H1: [t, t + clip] if clip > 0, else up to the next beat; the last one lasts 2 s."""
    clip = F.lit(0.0) if clip is None else clip
    ahead = neighbours(beats, TRACK, "beat_idx", lambda w: {"_next": F.lead("t").over(w)})
    end = F.when(clip > 0, F.col("t") + clip).otherwise(F.coalesce(F.col("_next"), F.col("t") + 2.0))
    return ahead.select("track_id", "beat_idx", F.col("t").alias("start_s"), end.alias("end_s"))


def default_clip(beats: DataFrame, *, requested: float) -> DataFrame:
    """H2: a request of 0 or less becomes the first interval, or 1 s for a single beat."""
    if requested > 0:
        return beats.select("track_id").distinct().withColumn("clip", F.lit(requested))
    first = F.max(F.when(F.col("beat_idx") == 1, F.col("t"))) - F.max(F.when(F.col("beat_idx") == 0, F.col("t")))
    return beats.groupBy("track_id").agg(F.coalesce(first, F.lit(1.0)).alias("clip"))


def split_at(points: DataFrame, durations: DataFrame) -> DataFrame:
    """H3: [0] + points + [duration] in the given order, neither sorted nor deduplicated."""
    ends = points.groupBy("track_id").agg((F.max("beat_idx") + 2).alias("ord")).join(durations, "track_id")
    rows = (
        points.select("track_id", (F.col("beat_idx") + 1).alias("ord"), "t")
        .unionByName(ends.select("track_id", F.lit(0).cast("long").alias("ord"), F.lit(0.0).alias("t")))
        .unionByName(ends.select("track_id", "ord", F.col("duration").alias("t")))
    )
    ahead = neighbours(rows, TRACK, "ord", lambda w: {"_next": F.lead("t").over(w)})
    return ahead.filter(F.col("_next").isNotNull()).select(
        "track_id", F.col("ord").alias("part"), F.col("t").alias("start_s"), (F.col("_next") - F.col("t")).alias("dur")
    )


def classify_gaps(beats: DataFrame, *, clip: float = 1.0) -> DataFrame:
    """One row per beat plus an INTRO row at beat_idx -1.

    kind is INTRO, BREAKDOWN or BEAT; ``dur`` is the time the row has to fill. The neighbours are written before they are
    read twice, so the sort by chunk and the join by track do not meet in one task, and a hot track's join may be split.
    """
    ahead = stage(neighbours(beats, TRACK, "beat_idx", lambda w: {"_next": F.lead("t").over(w), "x": F.col("t") - F.lag("t").over(w)}), "ahead")
    limits = filtered_average_interval(ahead, fallback=clip).select("track_id", (F.col("avg_interval") * LONG_GAP).alias("limit"))
    rows = ahead.join(limits, "track_id")
    gap = F.col("_next") - F.col("t")
    long_gap = F.coalesce(gap > F.col("limit"), F.lit(False))
    dur = F.when(F.col("_next").isNull(), F.lit(max(clip, MIN_SEGMENT))).when(gap <= 0, F.lit(MIN_SEGMENT)).otherwise(gap)
    own = F.struct("beat_idx", F.when(long_gap, "BREAKDOWN").otherwise("BEAT").alias("kind"), "t", dur.alias("dur"))
    intro = F.struct(F.lit(-1).cast("long").alias("beat_idx"), F.lit("INTRO").alias("kind"), F.lit(0.0).alias("t"), F.col("t").alias("dur"))
    late = (F.col("beat_idx") == 0) & (F.col("t") > F.col("limit"))
    return rows.select("track_id", F.inline(F.array_compact(F.array(own, F.when(late, intro)))))


def number_of(clips: DataFrame) -> int:
    """Size of a clip catalogue; there must be one clip to place."""
    n = clips.count()
    if n == 0:
        raise ValueError("the clip catalogue is empty")
    return n


def round_robin(rows: DataFrame, clips: DataFrame, *, advance_on: str | None = "BEAT") -> DataFrame:
    """H5: cycle through the clips; the pointer moves on BEAT rows, or (``None``) on every beat index."""
    n = number_of(clips)
    if advance_on is None:
        placed = rows.withColumn("_turn", F.col("beat_idx"))
    else:
        shifted = rows.withColumn("_i", F.col("beat_idx") + 1)
        placed = running_sum(shifted, TRACK, "_i", {"_turn": F.when(F.col("kind") == advance_on, 1).otherwise(0).cast("long")}).drop("_i")
        placed = placed.filter(F.col("kind") == advance_on)
    return placed.withColumn("clip_id", F.col("_turn") % F.lit(n).cast("long")).drop("_turn")


def source_offsets(assigned: DataFrame, clips: DataFrame) -> DataFrame:
    """H6: position inside the clip, moved to 0 (and shortened) where too little is left."""
    joined = assigned.join(clips.select("clip_id", F.col("duration").alias("_d")), "clip_id")
    known = F.coalesce(F.col("_d") > 0, F.lit(False))
    pos = F.col("t") % F.when(known, F.col("_d")).otherwise(F.lit(DEFAULT_CLIP))
    pos = F.when(known & (pos < 0.001), F.lit(0.0)).otherwise(pos)
    short = known & (F.col("_d") - F.col("_p") < F.col("dur"))
    placed = joined.withColumn("_p", pos)
    return placed.withColumns({
        "src_start": F.when(short, F.lit(0.0)).otherwise(F.col("_p")),
        "dur": F.when(short, F.least(F.col("dur"), F.col("_d"))).otherwise(F.col("dur")),
    }).drop("_p", "_d")


def clip_cycle(clips: DataFrame) -> DataFrame:
    """The order in which gaps take clips, longest first: ``rank, clip_id, d`` and ``before``, the time of all earlier ones."""
    length = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.lit(DEFAULT_CLIP)).cast("double")
    rows = clips.select(F.lit(0).alias("_all"), "clip_id", length.alias("d")).withColumn("_falling", -F.col("d"))
    ranked = stage(dense_index(rows, ["_all"], ["_falling", "clip_id"], "rank").select("_all", "rank", "clip_id", "d"), "ranked-clips")
    return running_sum(ranked, ["_all"], "rank", {"before": F.col("d")}).select("rank", "clip_id", "d", "before")


@lru_cache(maxsize=1)
def cycle_times(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the clips of a written cycle, and the n + 1 sums of what lies before each and after all."""
    store, inner, _ = files.open_store(path)
    table = pq.read_table(inner, columns=["rank", "d", "before"], filesystem=store, use_threads=False)
    order = np.argsort(table.column("rank").to_numpy())
    lengths, before = table.column("d").to_numpy()[order], table.column("before").to_numpy()[order]
    return lengths, np.append(before, before[-1] + lengths[-1])


def clips_needed(starts: np.ndarray, dur: float, lengths: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """How many clips fill ``dur`` from each start of the cycle: the fewest that leave no more than MIN_SEGMENT."""
    if dur <= MIN_SEGMENT:
        return np.zeros(len(starts), dtype=np.int64)
    n = len(lengths)
    rounds, rest = divmod(dur - MIN_SEGMENT, sums[n])
    wanted = sums[starts] + rest
    over = wanted > sums[n]
    inner = np.where(over, wanted - sums[n], wanted)
    at = np.searchsorted(sums, inner, side="left")
    many = int(rounds) * n + at + n * over - starts
    # where a fill ends within rounding of the limit, what decides is the remainder after one subtraction per clip
    close = (np.abs(sums[np.minimum(at, n)] - inner) < TIE) | (np.abs(sums[np.maximum(at - 1, 0)] - inner) < TIE)
    for k in np.flatnonzero(close).tolist():
        left, count = dur, 0
        while left > MIN_SEGMENT:
            left -= min(lengths[(starts[k] + count) % n], left)
            count += 1
        many[k] = count
    return many


def fill_long_gaps(gaps: DataFrame, clips: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """H8: fill each gap with whole clips, longest first, cycling on across gaps.

    The cycle is a table ranked by a range sort, with prefix sums of its times, in the shared folder. The carried state is
    the position in it, so a chunk of gaps is a map from start position to end position; where a fill ends is read from
    the sums for all starts at once. Gaps are numbered densely and a chunk holds no fewer gaps than there are clips, so all
    maps together have as many rows as there are gaps, and one cycle per track at most. That step needs the times alone:
    a Python worker reads them from the shared folder once, 16 bytes a clip; nothing passes through the driver and nothing
    is broadcast. It leaves one row per gap, a position and a number of clips; the pieces are then counted out and meet
    their clips by a join on rank. Returns (track_id, beat_idx, piece, clip_id, dur).
    """
    spark = gaps.sparkSession
    n = number_of(clips)
    path = new_path(spark, "cycle")
    clip_cycle(clips).write.parquet(path)
    cycle = spark.read.parquet(path)

    def summarise(run: Run) -> list[tuple[float, float]]:
        state, times = np.arange(n), cycle_times(path)
        for dur in run["dur"].tolist():
            # starts that have met stay together, so only distinct positions are advanced
            live, back = np.unique(state, return_inverse=True)
            state = ((live + clips_needed(live, dur, *times)) % n)[back]
        return [(NONE, float(state[0])), *zip(np.arange(n, dtype=float).tolist(), state.astype(float).tolist())]

    def emit(run: Run, entry: float) -> Run:
        at, first, many, times = max(int(entry), 0), [], [], cycle_times(path)
        for dur in run["dur"].tolist():
            first.append(at)
            many.append(int(clips_needed(np.array([at]), dur, *times)[0]))
            at = (at + many[-1]) % n
        first = np.array(first, dtype=np.int64)
        return {"beat_idx": run["beat_idx"], "at": first, "many": np.array(many, dtype=np.int64), "gap": run["dur"].astype(float), "offset": times[1][first], "turn": np.full(len(first), times[1][n])}

    dense = dense_index(gaps.select("track_id", "beat_idx", "dur"), TRACK, ["beat_idx"], "_gap")
    rows = dense.withColumn("_chunk", F.expr(f"_gap div {max(chunk, n)}")).drop("_gap")
    longs, doubles = ("beat_idx", "at", "many"), ("gap", "offset", "turn")
    out = T.StructType([*(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    placed = stage(carry_scan(rows, TRACK, order=["beat_idx"], initial=0.0, summarise=summarise, emit=emit, schema=out), "placed-gaps")
    pieces = counted(placed, "many", "piece", keys=("track_id", "beat_idx")).withColumn("_pos", F.col("at") + F.col("piece"))
    joined = pieces.withColumns({"rank": F.col("_pos") % n, "_turns": F.expr(f"_pos div {n}")}).join(cycle, "rank")
    earlier = F.col("_turns") * F.col("turn") + F.col("before") - F.col("offset")
    return joined.select("track_id", "beat_idx", "piece", "clip_id", F.least("d", F.col("gap") - earlier).alias("dur"))


def cli_segments(beats: DataFrame, durations: DataFrame, *, clip: float = 0.0) -> DataFrame:
    """H9: clip, else the next interval, else at least 0.5 s up to the end; always from source 0."""
    ahead = neighbours(beats, TRACK, "beat_idx", lambda w: {"_next": F.lead("t").over(w)}).join(durations, "track_id")
    tail = F.greatest(F.col("duration") - F.col("t"), F.lit(0.5))
    dur = F.lit(clip) if clip > 0 else F.coalesce(F.col("_next") - F.col("t"), tail)
    return ahead.select("track_id", "beat_idx", "t", F.lit(0.0).alias("src_start"), dur.alias("dur"))


def pad_to_length(totals: DataFrame, clips: DataFrame) -> DataFrame:
    """``totals(track_id, n_segments, total, duration)``; pieces of at most 2 s while over 0.1 s is missing."""
    left = F.col("duration") - F.col("total")
    short = totals.withColumn("_left", left).filter("_left > 0.5")
    count = F.ceil((F.col("_left") - 0.1) / 2.0 - 1e-9).cast("long")
    n = F.lit(number_of(clips)).cast("long")
    rows = counted(short.withColumn("_n", count), "_n", "_k")
    return rows.select(
        "track_id", (F.col("n_segments") + F.col("_k")).alias("segment"),
        ((F.col("n_segments") + F.col("_k")) % n).alias("clip_id"),
        F.least(F.lit(2.0), F.col("_left") - 2.0 * F.col("_k")).alias("dur"),
    )


def output_timeline(segments: DataFrame, *, idx: str = "seg_no", keys: Sequence[str] = TRACK) -> DataFrame:
    """Running start of each segment in the output."""
    return running_sum(segments, keys, idx, {"out_start": F.col("dur")})


def segments_from_peaks(peaks: DataFrame, durations: DataFrame) -> DataFrame:
    """A segment runs to the next boundary, the last one to the end of the track."""
    ahead = neighbours(peaks, TRACK, "seg_idx", lambda w: {"_next": F.lead("t").over(w)}).join(durations, "track_id")
    return ahead.select("track_id", "seg_idx", F.col("t").alias("start_s"), F.coalesce("_next", "duration").alias("end_s"))


def window_expressions(beats: DataFrame, *, width: float, per: int = PER_CHUNK) -> DataFrame:
    """``between(t,a,b)`` terms joined by '+', ``per`` beats to a row."""
    term = printf("between(t,%.6f,%.6f)", F.col("t"), F.col("t") + F.lit(width))
    rows = beats.select("track_id", F.expr(f"beat_idx div {per}").alias("chunk"), F.struct("beat_idx", term.alias("x")).alias("s"))
    packed = rows.groupBy("track_id", "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return packed.select("track_id", "chunk", F.array_join(F.transform("s", lambda s: s["x"]), "+").alias("enable"))


def _plain_number(value: Column) -> Column:
    """Decimal text with six significant digits, without trailing zeros."""
    return printf("%.6g", value.cast("double"))


def filter_chain(configs: DataFrame) -> DataFrame:
    """Colour, vignette and blur text, comma-joined, disabled parts skipped."""
    presets = F.create_map(*[F.lit(x) for pair in COLOR_FILTERS.items() for x in pair])
    color = F.when(F.col("enable_color"), F.try_element_at(presets, F.col("preset")))
    vignette = F.when(F.col("enable_vignette"), F.concat(F.lit("vignette=PI/"), _plain_number(F.lit(4.0) / F.col("vignette"))))
    blur = F.when(F.col("enable_blur"), F.concat(F.lit("gblur=sigma="), _plain_number(F.col("blur"))))
    return configs.withColumn("chain", F.concat_ws(",", color, vignette, blur))


def _part(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``_part``, the filter of each of their joints."""
    source = F.replace(F.col("path"), F.lit("'"), F.lit("\\'"))
    return jobs.withColumn("_part", F.concat(F.lit("gltransition=source='"), source, F.lit("':duration="), printf("%.3f", F.col("duration"))))


def _edge(joint: Column) -> Column:
    left = F.when(joint == 0, F.lit("[0:v]")).otherwise(F.concat(F.lit("[t"), joint.cast("string"), F.lit("]")))
    right = (joint + 1).cast("string")
    return F.concat(left, F.lit("["), right, F.lit(":v]"), F.col("_part"), F.lit("[t"), right, F.lit("]"))


def transition_edges(jobs: DataFrame) -> DataFrame:
    """One row ``edge`` per joint of ``jobs(n_inputs, path, duration)``; columns of the job are kept."""
    job = [c for c in jobs.columns if c not in ("path", "duration")]
    rows = _part(jobs).withColumn("_joints", F.col("n_inputs").cast("long") - 1)
    return counted(rows, "_joints", "joint", keys=job).withColumn("edge", _edge(F.col("joint"))).drop("_part", "_joints")


def transition_chain(jobs: DataFrame, key: str | None = None) -> DataFrame:
    """H15 as text: the edges of each job joined in order; empty below 2 inputs. ``key`` names a job and is not needed.

    The text of a job is one value anyway, so it is made where its row is: texts are neither shuffled nor joined.
    """
    joints = F.sequence(F.lit(0).cast("long"), F.col("n_inputs").cast("long") - 2)
    graph = F.when(F.col("n_inputs") >= 2, F.array_join(F.transform(joints, _edge), ";"))
    return _part(jobs).withColumn("graph", F.coalesce(graph, F.lit(""))).drop("_part")


def overlap_segments(samples: DataFrame, *, length: int) -> DataFrame:
    """hop = length - length/4, ceil(n/hop) segments; (track_id, seg, pos, v), the tail zero-padded by absence."""
    hop = max(1, length - length // 4)
    first = F.greatest(F.ceil((F.col("idx") - (length - 1)) / F.lit(hop)), F.lit(0)).cast("long")
    spread = samples.withColumn("seg", F.explode(F.sequence(first, F.expr(f"idx div {hop}"))))
    return spread.select("track_id", "seg", (F.col("idx") - F.col("seg") * hop).alias("pos"), "v")


def overlap_add(segments: DataFrame, *, length: int, symmetric: bool = False, size: str | None = None, partitions: int | None = None) -> DataFrame:
    """Blend the first quarter of each later segment into what is there, overwrite elsewhere.

    With a quarter overlap at most two segments meet at a sample, a head and the tail before it; only these are grouped,
    what lies between goes straight through. ``symmetric`` fades the earlier segment by the complement of the plain
    ramp instead of the one-sided weight. ``size`` names a column with the length of the row's segment, where it is known;
    ``partitions`` is the number of parts in which heads meet tails, so that a caller who knows the rows bounds a part.
    """
    fade = length // 4
    hop = max(1, length - fade)
    sized = with_stats(segments, ["track_id", "seg"], _len=F.max("pos") + 1) if size is None else segments.withColumn("_len", F.col(size))
    pos, span = F.col("pos"), F.col("_len")
    ramp = pos / F.lit(float(max(fade, 1)))
    tail = F.when((span >= fade) & (pos >= span - fade), (span - 1 - pos) / F.lit(float(max(fade, 1)))).otherwise(F.lit(1.0))
    weight = ramp if symmetric else ramp * tail
    is_head, is_tail = (F.col("seg") > 0) & (pos < fade), pos >= hop
    rows = sized.select("track_id", (F.col("seg") * hop + pos).alias("idx"), "v", F.when(is_head, weight).alias("_w"), is_head.alias("_head"), (is_head | is_tail).alias("_meets"))
    alone = rows.filter(~F.col("_meets")).select("track_id", "idx", "v")
    meeting = rows.filter("_meets").withColumn("_home", F.expr(f"idx div {hop}"))
    if partitions is not None:
        meeting = meeting.repartition(partitions, "track_id", "_home")
    head = F.col("_head")
    merged = meeting.groupBy("track_id", "_home", "idx").agg(
        F.max(F.when(head, F.col("v"))).alias("h"), F.max(F.when(head, F.col("_w"))).alias("w"), F.max(F.when(~head, F.col("v"))).alias("b"), F.count(F.lit(1)).alias("n")
    )
    base = F.when(F.col("n") > 1, F.col("b")).otherwise(F.lit(0.0))
    value = F.when(F.col("w").isNull(), F.col("b")).otherwise(base * (F.lit(1.0) - F.col("w")) + F.col("h") * F.col("w"))
    return alone.unionByName(merged.select("track_id", "idx", value.alias("v")))
