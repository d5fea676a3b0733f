"""Removal of byte strings that occur more than once, by prefix-free parsing.

A rolling hash puts triggers into every text and so cuts it into phrases; all that is compared later hangs on triggers.
Suffixes are told apart to the depth of one window (400 bytes), which is all that the result depends on. Equal suffixes
are found by key instead of by a sort of the whole corpus: a hot phrase then costs a count and no long run of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare, row_runs, text_slices, unburdened
from pulsegrid.session import stage

WINDOW = 400
TRIGGER = 8  # bytes under the rolling hash
PASSAGE = 50  # words of the shortest repeated passage
CHUNK = 1 << 20  # window starts that are parsed at once
SMALL = 8  # windows of a small part, where a core has very many parts
GROUP = 256  # different phrase parts that one task compares; more go by single windows
HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Grain:
    """What a window counts: bytes (``size`` 1), or words, each of which stands as its hash of ``size`` 8 bytes."""

    window: int
    size: int = 1
    reach_bits: int = 7  # 2 to this many windows make one phrase part

    def read(self, raw: bytes) -> bytes:
        """The units of a text, one after the other."""
        return raw if self.size == 1 else b"".join(map(xxhash.xxh64_digest, raw.split()))

    def rolling(self, units: bytes) -> np.ndarray:
        """A hash at each unit where a trigger may lie: of ``TRIGGER`` bytes, or the word's own."""
        if self.size > 1:
            return np.frombuffer(units, np.uint64).copy()
        value = np.empty(len(units) - TRIGGER + 1, np.uint64)
        for shift in range(min(TRIGGER, len(value))):
            count = (len(value) - shift + TRIGGER - 1) // TRIGGER
            value[shift::TRIGGER] = np.frombuffer(units[shift : shift + count * TRIGGER], np.uint64)
        return value

    def places(self, raw: bytes, ranges: np.ndarray) -> np.ndarray:
        """Ranges of units as ranges of bytes; a range of words takes the white space behind it along."""
        if self.size == 1 or not len(ranges):
            return ranges
        blank = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        starts = np.append(np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])), len(raw))
        return starts[ranges]


BYTES, WORDS = Grain(WINDOW), Grain(PASSAGE, 8, 4)


def trigger_of(value: np.ndarray, wide: int) -> np.ndarray:
    """For each window start the position of its trigger: the leftmost smallest rolling hash at the window's ``wide`` places.

    The trigger depends on the window's own units alone, so equal windows have it at the same place.
    """
    positions = len(value)
    value *= HASH
    value ^= value >> np.uint64(32)
    value *= HASH
    value &= np.uint64(0xFFFFFFFF00000000)
    value |= np.arange(positions, dtype=np.uint64)
    blocks = -(-positions // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:positions] = value
    square = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(square, axis=1).ravel()
    starts = positions - wide + 1
    return (np.minimum(ahead[:starts], behind[wide - 1 : wide - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrase_parts(units: bytes, grain: Grain = BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The window starts of one text in runs of like trigger: first start, number of starts, trigger minus first start.

    Starts of one run have the same trigger and lie within the same ``2 ** reach_bits`` units before it. Where a long
    text is cut into chunks a run may be cut as well, which changes nothing in the result.
    """
    wide = grain.window - TRIGGER + 1 if grain.size == 1 else grain.window
    for at in range(0, len(units) // grain.size - grain.window + 1, CHUNK):
        part = units[at * grain.size : (at + CHUNK + grain.window - 1) * grain.size]
        trigger = trigger_of(grain.rolling(part), wide)
        start = np.arange(len(trigger))
        kind = (trigger << grain.reach_bits) | ((trigger - start) >> grain.reach_bits)
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        yield first + at, np.diff(np.append(first, len(trigger))), trigger[first] - first


def pack_place(first: np.ndarray, count: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    return (first << 20) | ((count - 1) << 10) | ahead


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 20, ((place >> 10) & 1023) + 1, place & 1023


def rows_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``mark`` and ``text``; the two first tell rows apart unless they are equal."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))


def parsed(rows: DataFrame, grain: Grain, whole: bool) -> DataFrame:
    """All phrase parts. ``core`` hashes the bytes that every window of a part must hold, whatever lies around.

    With ``whole`` also ``k1, k2``, a 128-bit hash of all units of the part's windows, and its place.
    """
    size, window = grain.size, grain.window
    kind = rows.schema["doc_id"].dataType.simpleString()
    kept = window - (1 << grain.reach_bits) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                cores: list[int] = []
                wholes: list[bytes] = []
                places: list[np.ndarray] = []
                owner: list[int] = []
                for k, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
                    units = grain.read(raw) if len(raw) >= window else b""
                    if len(units) < window * size:
                        continue
                    view = memoryview(units)
                    for first, count, ahead in phrase_parts(units, grain):
                        base = (first + ahead - (ahead >> grain.reach_bits << grain.reach_bits)) * size
                        cores += [short(view[a : a + kept * size]) for a in base.tolist()]
                        owner += [k] * len(first)
                        if whole:
                            places.append(pack_place(first, count, ahead))
                            wholes += [long(view[a : a + n]) for a, n in zip((first * size).tolist(), ((count + window - 1) * size).tolist(), strict=True)]
                if not cores:
                    continue
                columns = {"core": pa.array(np.array(cores, np.uint64).view(np.int64))}
                if whole:
                    both = np.frombuffer(b"".join(wholes), np.int64).reshape(-1, 2)
                    index = pa.array(owner)
                    columns |= {"k1": pa.array(both[:, 0]), "k2": pa.array(both[:, 1]), "doc_id": part.column(0).take(index), "mark": part.column(1).take(index), "place": pa.array(np.concatenate(places))}
                yield pa.RecordBatch.from_pydict(columns)

    more = f", k1 long, k2 long, doc_id {kind}, mark long, place long" if whole else ""
    return rows.mapInArrow(unburdened(work), f"core long{more}")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def repeated_ranges(rows: DataFrame, grain: Grain = BYTES) -> DataFrame:
    """``doc_id, mark, a, b``: ranges of units covered by windows that occur elsewhere as well. Ranges may overlap.

    1. A part can hold a repeated window only if its core occurs twice.
    2. Of those, parts that occur twice as a whole are repeated whole.
    3. The others are compared, window by window, with one copy of each different part of the same core.
    """
    size, window = grain.size, grain.window
    kind = rows.schema["doc_id"].dataType.simpleString()
    cores = stage(parsed(rows, grain, False).groupBy("core").count().where("count > 1").select("core"), "cores")
    found = stage(parsed(rows, grain, True).join(cores, "core"), "parts")
    wholes = stage(
        found.groupBy("core", "k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "place")).alias("one")).select("core", "k1", "k2", "n", "one.*"), "wholes"
    )
    twice = stage(wholes.where("n > 1").select("k1", "k2"), "twice")
    first, count = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(1023) + 1
    full = found.join(twice, ["k1", "k2"]).select("doc_id", "mark", first.alias("a"), (first + count + window - 1).alias("b"))

    kinds = wholes.groupBy("core").agg(F.count("*").alias("kinds"), F.max(F.col("n") == 1).alias("open")).where("open AND kinds > 1").select("core", (F.col("kinds") > GROUP).alias("hot"))
    asked = stage(wholes.select("core", (F.col("n") == 1).alias("open"), "doc_id", "mark", "place").join(stage(kinds, "kinds"), "core"), "asked")
    lists = stage(asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("core", "open", "hot", "place")).alias("parts")), "lists")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                lists = part.column(3)
                owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                own = lists.flatten()
                place = own.field("place").to_numpy()
                first, count, ahead = unpack_place(place)
                raws = [grain.read(raw) for raw in texts.cast(pa.binary()).to_pylist()]
                pieces = [raws[k][a : a + n] for k, a, n in zip(owner.tolist(), (first * size).tolist(), ((count + window - 1) * size).tolist(), strict=True)]
                index = pa.array(owner)
                yield pa.RecordBatch.from_pydict(
                    {"core": own.field("core"), "open": own.field("open"), "hot": own.field("hot"), "doc_id": part.column(0).take(index), "mark": part.column(1).take(index), "first": pa.array(first), "ahead": pa.array(ahead), "piece": pa.array(pieces, pa.binary())}
                )

    joined = rows.join(lists, same_row(rows, lists)).select(rows["doc_id"], rows["mark"], "text", "parts")
    pieces = stage(joined.mapInArrow(unburdened(cut), f"core long, open boolean, hot boolean, doc_id {kind}, mark long, first long, ahead long, piece binary"), "pieces")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in row_runs(batches, "core", 4_000):
            core, piece = group.column("core").to_numpy(), group.column("piece").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(core)) + 1).tolist(), len(core)]
            opened = group.column("open").to_numpy(zero_copy_only=False)
            owner, begin, end = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                marks = [windows(p, grain) for p in piece[lo:hi]]
                seen = Counter(m for own in marks for m in own)
                for k, own in enumerate(marks):
                    if opened[lo + k]:
                        for a, b in runs([seen[m] > 1 for m in own]):
                            owner.append(lo + k)
                            begin.append(a)
                            end.append(b)
            index = pa.array(owner, pa.int64())
            first = group.column("first").to_numpy()[np.array(owner, np.int64)]
            a, b = first + np.array(begin, np.int64), first + np.array(end, np.int64) + window - 1
            yield pa.RecordBatch.from_pydict({"doc_id": group.column("doc_id").combine_chunks().take(index), "mark": group.column("mark").combine_chunks().take(index), "a": pa.array(a), "b": pa.array(b)})

    cold = pieces.where("NOT hot").repartition(parts, "core").sortWithinPartitions("core").mapInArrow(unburdened(compare), f"doc_id {kind}, mark long, a long, b long")
    return full.unionByName(cold).unionByName(hot_ranges(pieces.where("hot"), grain))


def hot_ranges(pieces: DataFrame, grain: Grain) -> DataFrame:
    """Repeated ranges of phrase parts whose core has very many of them, by counts alone.

    As before with smaller parts: a part is cut into ``SMALL`` windows each; those that occur twice as a whole are
    repeated whole, and of the others only those whose own core occurs in different parts go on window by window. So a
    part costs a row per small part and the windows around the place where it begins to differ.
    """
    size, window = grain.size, grain.window
    kind = pieces.schema["doc_id"].dataType.simpleString()
    place = f"open boolean, doc_id {kind}, mark long, first long"

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            owner, begin, small, cores, wholes = [], [], [], [], []
            for k, (piece, ahead) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                count = len(piece) // size - window + 1
                # cut where the distance to the trigger passes a multiple of SMALL, which is the same in every copy
                starts = [0, *range(ahead % SMALL + 1, count, SMALL)]
                for a, z in zip(starts, [*starts[1:], count], strict=True):
                    owner.append(k)
                    begin.append(a)
                    small.append(piece[a * size : (z + window - 1) * size])
                    low = ahead % SMALL if a == 0 else a + SMALL - 1  # the last start that a whole small part would have
                    cores.append(short(piece[low * size : (low - SMALL + 1 + window) * size]))
                    wholes.append(long(small[-1]))
            both = np.frombuffer(b"".join(wholes), np.int64).reshape(-1, 2)
            index = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "open": batch.column(0).take(index), "doc_id": batch.column(1).take(index), "mark": batch.column(2).take(index),
                    "first": pc.add(batch.column(3).take(index), pa.array(begin, pa.int64())), "piece": pa.array(small, pa.binary()),
                    "core": pa.array(np.array(cores, np.uint64).view(np.int64)), "k1": pa.array(both[:, 0]), "k2": pa.array(both[:, 1]),
                }
            )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [windows(piece, grain) for piece in batch.column(4).to_pylist()]
            count = np.array([len(m) for m in marks], np.int64)
            both = np.frombuffer(b"".join(m for own in marks for m in own), np.int64).reshape(-1, 2)
            index = pa.array(np.repeat(np.arange(len(marks)), count))
            inner = np.arange(len(both)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_pydict(
                {
                    "w1": pa.array(both[:, 0]), "w2": pa.array(both[:, 1]), "open": batch.column(0).take(index), "doc_id": batch.column(1).take(index),
                    "mark": batch.column(2).take(index), "a": pc.add(batch.column(3).take(index), pa.array(inner)),
                }
            )

    small = stage(pieces.select("open", "doc_id", "mark", "first", "piece", "ahead").mapInArrow(unburdened(divide), f"{place}, piece binary, core long, k1 long, k2 long"), "small")
    whole = stage(
        small.groupBy("core", "k1", "k2").agg(F.count("*").alias("n"), F.max("open").alias("open"), *[F.first(c).alias(c) for c in ("doc_id", "mark", "first", "piece")]), "small-wholes"
    )
    twice = stage(whole.where("n > 1").select("k1", "k2"), "small-twice")
    full = small.where("open").join(twice, ["k1", "k2"]).select("doc_id", "mark", F.col("first").alias("a"), (F.col("first") + (F.length("piece") / size).cast("long")).alias("b"))
    lone = whole.withColumn("open", F.col("open") & (F.col("n") == 1))
    wanted = stage(lone.groupBy("core").agg(F.count("*").alias("kinds"), F.max("open").alias("open")).where("kinds > 1 AND open").select("core"), "small-cores")
    asked = lone.join(wanted, "core").select("open", "doc_id", "mark", "first", "piece")
    split = stage(asked.mapInArrow(unburdened(single), f"w1 long, w2 long, open boolean, doc_id {kind}, mark long, a long"), "windows")
    again = stage(split.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), "again")
    return full.unionByName(split.where("open").join(again, ["w1", "w2"]).select("doc_id", "mark", "a", (F.col("a") + window).alias("b")))


def windows(piece: bytes, grain: Grain) -> list[bytes]:
    view, digest, wide = memoryview(piece), xxhash.xxh3_128_digest, grain.window * grain.size
    return [digest(view[a : a + wide]) for a in range(0, len(piece) - wide + 1, grain.size)]


def runs(flags: list[bool]) -> list[tuple[int, int]]:
    """Half-open ranges of true flags."""
    if not any(flags):
        return []
    change = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def merge(ranges: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, maximal ranges with the same cover."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    begins = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[begins, 0], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(ranges) - 1)]], axis=1)


def remove_repeats(docs: DataFrame, grain: Grain = BYTES, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Every text without what is covered by a string of ``grain.window`` bytes or words that also starts anywhere else.

    ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) and the ``carry`` columns, one row per row of
    ``docs``. Texts are UTF-8 bytes, null counts as empty, and strings never cross documents. Rows that repeat are
    documents of their own, so their texts repeat. Null ids are allowed; columns not carried are ignored. With
    ``as_text`` the remaining bytes are read as UTF-8, without the rest of characters that were cut. With ``WORDS``
    strings are sequences of words between ASCII white space, which goes with the word before it.
    """
    prepare(docs.sparkSession)
    rows = rows_of(docs)
    ranges = repeated_ranges(rows, grain).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    ranges = stage(ranges, "ranges").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "ranges")
    carried = docs.select(F.struct("doc_id", *(carry or [])).alias("carried"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    joined = carried.join(ranges, F.col("carried.doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sizes, removed, spans, kept = [], [], [], []
                for raw, ranges in zip(texts.cast(pa.binary()).to_pylist(), part.column(2), strict=True):
                    own = ranges.values
                    found = merge(np.stack([own.field("a").to_numpy(), own.field("b").to_numpy()], axis=1)) if own is not None and len(own) else np.zeros((0, 2), np.int64)
                    found = grain.places(raw, found)
                    edges = [0, *found.ravel().tolist(), len(raw)]
                    sizes.append(len(raw))
                    removed.append(int((found[:, 1] - found[:, 0]).sum()))
                    spans.append(len(found))
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_pydict(
                    {"carried": part.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())}
                )

    out = f"carried {carried.schema['carried'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    stripped = joined.select("carried", "text", "ranges").mapInArrow(unburdened(strip), out)
    return stripped.select("carried.*", "n_bytes", "n_removed", "n_spans", "kept")
