"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import vocab
from pulsegrid.llm.common import prepare, text_slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """Token ids of every whole text: ``doc_id``, ``ids`` and, with ``offsets``, ``starts`` and ``ends``.

    Offsets count characters of the text and are half open; a token that holds only some bytes of a character spans
    that whole character. A null text counts as empty and gives no ids. Rows are kept one for one, repeated ids and
    null ids included; other columns are ignored.
    """
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.byte_encoder(path, pattern)
        sizes = np.array([len(t) for t in vocab.token_bytes(path)], np.int64) if offsets else None
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                ids, counts = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = {"doc_id": rows.column(0), "ids": pa.ListArray.from_arrays(ends, pa.array(ids))}
                if offsets:
                    first, last = character_spans(texts, sizes[ids], counts)
                    columns["starts"] = pa.ListArray.from_arrays(ends, pa.array(first))
                    columns["ends"] = pa.ListArray.from_arrays(ends, pa.array(last))
                yield pa.RecordBatch.from_pydict(columns)

    spans = ", starts array<int>, ends array<int>" if offsets else ""
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>{spans}")


def character_spans(texts: pa.Array, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each token, from the tokens' byte lengths."""
    raw = texts.cast(pa.binary())
    borders = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    stop = np.cumsum(sizes)
    text_first = np.repeat(borders[:-1] - borders[0], counts)
    zero = character[text_first] if len(stop) else stop
    start = stop - sizes
    return (character[start] - zero).astype(np.int32), (character[stop - 1] + 1 - zero).astype(np.int32)


def joined_bytes(ids: np.ndarray, counts: np.ndarray, table: list[bytes]) -> list[bytes]:
    """The bytes of each run of ids: their tokens' bytes one after the other."""
    tokens, ends = list(map(table.__getitem__, ids.tolist())), np.cumsum(counts).tolist()
    return [b"".join(tokens[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The bytes and text that ``ids`` stand for: ``doc_id``, ``bytes``, ``text``.

    Bytes are joined before they are read as UTF-8, so characters split over tokens come back whole; bytes that form no
    character (ids cut inside one) become U+FFFD in ``text`` and stay as they are in ``bytes``. Null ids count as none.
    An id outside the vocabulary is an error.
    """
    prepare(encoded.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocab.token_bytes(path)
        for batch in batches:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            out = joined_bytes(lists.flatten().to_numpy(), counts, table)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bytes": pa.array(out, pa.binary()), "text": pa.array([b.decode("utf-8", "replace") for b in out], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``ids`` and the ``bytes`` they decode to, encoded and decoded by one worker."""
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = vocab.byte_encoder(path, pattern), vocab.token_bytes(path)
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                ids, counts = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "ids": lists, "bytes": pa.array(joined_bytes(ids, counts, table), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and SHA-256 of the ids and of what they decode to."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
