"""Packing of token sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm import vocab
from pulsegrid.llm.common import prepare, text_slices
from pulsegrid.session import stage

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END = 1
RANK_GROUP = 256  # pieces that one group ranks, about; more where MAX_GROUPS groups would be too few
MAX_GROUPS = 8192
SLICE = 2 << 20  # bytes of text whose ids are in memory at once


def tokenised_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Every document's ids with a closing ``end`` id, cut after each ``length`` ids.

    One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``ids``. A null or empty text is
    the ``end`` id alone. Repeated rows are documents of their own; other columns are ignored.
    """
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.word_encoder(path)
        for batch in batches:
            for rows, texts in text_slices(batch, "text", SLICE):
                ids, counts = encoder.encode(texts)
                own = counts + 1
                closed = np.full(int(own.sum()), end, np.uint32)
                ends = np.cumsum(own)
                keep = np.ones(len(closed), bool)
                keep[ends - 1] = False
                closed[keep] = ids
                pieces = -(-own // length)
                doc = np.repeat(np.arange(len(own)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * length
                size = np.minimum(length, own[doc] - start)
                first = (ends - own)[doc] + start
                raw = closed.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column(0).take(pa.array(doc)),
                        "start": pa.array(start.astype(np.int64)),
                        "length": pa.array(size.astype(np.int64)),
                        "ids_crc32": pa.array(np.array(crc, np.int64)),
                        "doc_tokens": pa.array(own[doc].astype(np.int64)),
                        "ids": pa.ListArray.from_arrays(offsets, pa.array(closed.astype(np.int32))),
                    }
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Packing patterns ``(count, lengths)`` for a histogram of lengths up to ``size``.

    Lengths are placed longest first; each goes into the packs with the most room left, if it fits there, else into
    packs of its own. Packs with equal contents are one pattern with a count, so the work follows the number of
    distinct lengths and not the number of pieces.
    """
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # by room: count, (length, times)
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def keep(room: int, count: int, held: list[tuple[int, int]]) -> None:
        (open_packs[room] if room else done).append((count, held))

    for length in range(size, 0, -1):
        left = histogram.get(length, 0)
        while left:
            room = max(open_packs, default=0)
            if room >= length:
                count, held = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
            else:
                room, count, held = size, left, []
            times = room // length
            filled = min(count, left // times)
            if filled:
                keep(room - times * length, filled, [*held, (length, times)])
                left, count = left - filled * times, count - filled
            if count and 0 < left < times:
                keep(room - left * length, 1, [*held, (length, left)])
                left, count = 0, count - 1
            if count and held:
                keep(room, count, held)
    for packs in open_packs.values():
        done += packs
    return [(count, [n for n, times in held for _ in range(times)]) for count, held in done]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length its places in rank order: first rank, first sequence id, offset in the sequence."""
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            places[n].append((taken[n], sequence, offset))
            taken[n] += count
            offset += n
        sequence += count
    return {n: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for n, rows in places.items()}


def dealt(pieces: DataFrame) -> DataFrame:
    """Pieces with the group ``_salt`` that ranks them. ``_deal`` numbers the written rows, so equal rows spread as well."""
    groups = min(MAX_GROUPS, max(1, pieces.count() // RANK_GROUP))
    return pieces.withColumn("_salt", F.pmod(F.xxhash64("_deal"), F.lit(groups))).drop("_deal")


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, in groups, so that a very common length is no single group."""
    salted = dealt(pieces)
    counts = salted.groupBy("length", "_salt").count()
    below = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    own = salted.withColumn("_own", F.row_number().over(inside) - 1)
    return own.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own")).drop("_salt", "_base", "_own")


def pack(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``.

    Only the histogram (at most ``size`` counts) reaches the driver. Patterns are cut into places, a run of ranks of one
    length each, and a piece finds its place by its length and rank. The places follow ``size``, not the pieces. Which of
    the pieces of one length takes which place depends on how the rows were dealt to tasks.
    """
    pieces = stage(pieces.withColumn("_deal", F.monotonically_increasing_id()), "pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    where = slots(shortest_pack_first(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                first, base, inner = where[n]
                at = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = base[at] + rank[mine] - first[at], inner[at]
            kept = {c: batch.column(i) for i, c in enumerate(names) if c != "_rank"}
            yield pa.RecordBatch.from_pydict({**kept, "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    with_rank = ranked(pieces)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in with_rank.schema.fields if f.name != "_rank"]
    return with_rank.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents with their places, without the ids themselves.

    Padding: a sequence is padded to ``size`` unless its length is a power of two. An empty table packs into no rows.
    """
    return pack(tokenised_pieces(docs, path, size, end).drop("ids"), size)
