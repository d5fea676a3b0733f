"""Alignment of two tokenizers over a corpus: every distinct text once, pair counts weighted by its copies.

Texts are shuffled by their whole content, so copies meet and are tokenised once. A text is cut at single spaces, where
neither vocabulary can put one token over the cut; a part's tokens, groups and links do not depend on what stands around
it and are remembered by the worker. Pair counts never travel per document: a block of texts sends each of its pairs
once, and gets back each pair's corpus-wide count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pulsegrid.llm.common import prepare, remember, spread, text_slices
from pulsegrid.llm.vocab import INNER_SPACE, byte_table, parts_with_space
from pulsegrid.session import stage

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
MAX_PARTS = 400_000  # parts remembered per worker before the memory starts afresh
SHIFT = 20  # bits of a B id in a pair's code
SPACE = "▁"  # fixed value: how pieces write a space


class PartAligner:
    """Tokens, groups and links of text parts, each part led by one space."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        value = {c: k for k, c in enumerate(byte_table())}
        own = self.a.get_vocab()
        self.bytes_a = [b""] * (max(own.values()) + 1)
        for token, at in own.items():
            self.bytes_a[at] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.size_a, self.size_b = (np.array(list(map(len, table)), np.int64) for table in (self.bytes_a, self.bytes_b))
        # ids as text with what follows them in a list of groups; the end of a part is a line break
        self.words = [f"{k}{after}" for after, n in ((",", len(self.bytes_a)), ("|", len(self.bytes_a)), (",", len(self.bytes_b)), (";", len(self.bytes_b)), ("\n", len(self.bytes_b))) for k in range(n)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((1 << 14, 5), np.int64)  # tokens of A, of B, groups, links, 1 if the bytes are the part's
        self.links, self.first, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """The memory's numbers of ``words``, different parts without their leading space."""
        found = list(map(self.known.get, words))
        if None in found:
            new = [w for w, at in zip(words, found, strict=True) if at is None]
            if len(self.known) + len(new) > MAX_PARTS:
                self._forget()
                new = words
            for at in range(0, len(new), 20_000):
                self._learn(new[at : at + 20_000])
            found = list(map(self.known.__getitem__, words))
        return np.array(found, np.int64)

    def _learn(self, words: list[str]) -> None:
        (got,) = self.a.encode_batch([[" " + w for w in words]], is_pretokenized=True, add_special_tokens=False)
        count_a = np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))
        lists = self.b.encode(words, num_threads=1)
        count_b = np.array(list(map(len, lists)), np.int64)
        ids_a, ids_b = np.array(got.ids, np.int64), np.array(list(chain.from_iterable(lists)), np.int64)
        same = self._same_bytes(words, ids_a, ids_b, count_a, count_b)
        kept_a, kept_b = ids_a[np.repeat(same, count_a)], ids_b[np.repeat(same, count_b)]
        groups, links, n_groups, n_links = self._aligned(kept_a, kept_b, count_a[same], count_b[same])

        n, m, used = len(self.known), len(words), self.used
        self.facts, self.first, self.links = (room(array, size) for array, size in ((self.facts, n + m), (self.first, n + m), (self.links, used + len(links))))
        facts = np.zeros((m, 5), np.int64)
        facts[same] = np.stack([count_a[same], count_b[same], n_groups, n_links, np.ones(len(n_links), np.int64)], axis=1)
        self.facts[n : n + m] = facts
        self.first[n : n + m] = used + np.cumsum(facts[:, 3]) - facts[:, 3]
        self.links[used : used + len(links)] = links
        self.used += len(links)
        self.known.update(zip(words, range(n, n + m), strict=True))
        if same.all():
            self.groups += groups
        else:
            given = iter(groups)
            self.groups += [next(given) if good else "" for good in same.tolist()]

    def _same_bytes(self, words: list[str], ids_a: np.ndarray, ids_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> np.ndarray:
        """Whether each word's tokens, of A and of B, hold the bytes of the word led by a space.

        If all have the right length and their bytes in a row are the words' bytes in a row, all are right.
        """
        raw = [b" " + w.encode() for w in words]
        size = np.array(list(map(len, raw)), np.int64)
        lengths = [np.diff(np.concatenate([[0], np.cumsum(table[ids])])[np.concatenate([[0], np.cumsum(count)])]) for table, ids, count in ((self.size_a, ids_a, count_a), (self.size_b, ids_b, count_b))]
        tokens = [list(map(table.__getitem__, ids.tolist())) for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        if all((own == size).all() for own in lengths) and b"".join(tokens[0]) == b"".join(tokens[1]) == b"".join(raw):
            return np.ones(len(words), bool)
        ends = [[0, *np.cumsum(count).tolist()] for count in (count_a, count_b)]
        return np.array([all(b"".join(own[at[k] : at[k + 1]]) == r for own, at in zip(tokens, ends, strict=True)) for k, r in enumerate(raw)], bool)

    def _aligned(self, ids_a: np.ndarray, ids_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Each part's groups as text, all codes of linked pairs, and the numbers of both in each part, for parts whose
        two token runs hold the same bytes."""
        none = np.zeros(0, np.int64)
        if not len(count_a):
            return [], none, none, none
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        first = np.searchsorted(end_b, end_a - self.size_a[ids_a], side="right")
        met = np.searchsorted(end_b, end_a, side="left")
        reach = met - first + 1
        codes = (np.repeat(ids_a, reach) << SHIFT) | ids_b[spread(first, reach)]
        last_a, last_b = np.cumsum(count_a) - 1, np.cumsum(count_b) - 1
        cut_a = end_b[met] == end_a  # a group ends with these tokens of A
        cut_b = np.zeros(len(ids_b), bool)
        cut_b[met[cut_a]] = True
        n_links, n_groups = np.diff(np.cumsum(reach)[last_a], prepend=0), np.diff(np.cumsum(cut_a)[last_a], prepend=0)
        # tokens in the order of the text: group by group, those of A ahead
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        code_a = ids_a + n_a * cut_a
        code_b = 2 * n_a + ids_b + n_b * cut_b
        code_b[last_b] += n_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        text = "".join(map(self.words.__getitem__, np.concatenate([code_a, code_b])[order].tolist()))
        return text[:-1].split("\n"), codes, n_groups, n_links


def room(array: np.ndarray, size: int) -> np.ndarray:
    """``array``, or a longer copy of it that holds ``size`` rows."""
    if size <= len(array):
        return array
    grown = np.zeros((max(size, 2 * len(array)), *array.shape[1:]), array.dtype)
    grown[: len(array)] = array
    return grown


def different(values: np.ndarray) -> np.ndarray:
    """The sorted different values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> PartAligner:
    remember(aligner.cache_clear)
    return PartAligner(path_a, path_b)


KEY = ("k1", "k2")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = (
    "block long, k1 long, k2 long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, parts array<int>, "
    "pairs array<long>, weights array<long>, part_pairs array<int>, part_sizes array<int>"
)


def text_key() -> tuple[Column, Column]:
    """128 bits that stand for a text when measures go back to its documents."""
    return F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")


def blocks(distinct: DataFrame, path_a: str, path_b: str, groups: bool) -> DataFrame:
    """Distinct texts (``text, copies``) tokenised and aligned, in blocks of one slice of a batch.

    A text's row holds its measures and ``parts``, numbers of the block's parts. One row more for each block, with null
    keys, holds its different id pairs, in how many documents of the block each is linked, and the pairs of each part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, schema = aligner(path_a, path_b), arrow_schema()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                yield one_block(memory, number, rows, texts, groups, schema)
                number += 1

    return distinct.select(*text_key(), "text", "copies").mapInArrow(work, BLOCKS)


def arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in BLOCKS.split(", "))])


def parts_of(texts: pa.Array) -> pa.ListArray:
    """Texts cut at single spaces between two other characters; a space at either end stays with its part."""
    split = parts_with_space(texts)
    edge = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")).to_numpy(zero_copy_only=False)
    if not edge.any():
        return split
    return pa.array([INNER_SPACE.split(t.as_py()) if e else p.as_py() for t, p, e in zip(texts, split, edge, strict=True)], pa.list_(pa.string()))


def one_block(memory: PartAligner, number: int, rows: pa.RecordBatch, texts: pa.Array, groups: bool, schema: pa.Schema) -> pa.RecordBatch:
    split = parts_of(texts)
    starts = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    starts = starts - starts[0]
    code, words = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
    at = memory.look_up(words)
    facts = memory.facts[at]
    n = len(texts)
    sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(facts[code], axis=0)])
    totals = sums[starts[1:]] - sums[starts[:-1]]
    whole = totals[:, 4] == np.diff(starts)
    totals = totals * whole[:, None]
    shown = list(map(memory.groups.__getitem__, at.tolist()))
    bounds, codes = starts.tolist(), code.tolist()
    texts_of = [";".join([shown[c] for c in codes[p:q]]) if ok else "" for p, q, ok in zip(bounds[:-1], bounds[1:], whole.tolist(), strict=True)]
    digests = [hashlib.sha256(t.encode()).hexdigest() if ok else "" for t, ok in zip(texts_of, whole.tolist(), strict=True)]

    sizes = facts[:, 3]
    pairs, local = np.unique(memory.links[spread(memory.first[at], sizes)], return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(starts))
    once = different((owner * max(1, len(words)) + code)[whole[owner]])
    owner, part = once // max(1, len(words)), once % max(1, len(words))
    first = np.cumsum(sizes) - sizes
    held = different(np.repeat(owner, sizes[part]) * max(1, len(pairs)) + local[spread(first[part], sizes[part])])
    copies = rows.column(rows.schema.get_field_index("copies")).to_numpy()
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, held % max(1, len(pairs)), copies[held // max(1, len(pairs))])

    used = np.flatnonzero(weights > 0)  # pairs of texts that have no tokens are of no use to anyone
    columns = {
        "block": pa.array(np.full(n + 1, number)),
        "k1": pa.concat_arrays([rows.column(0), pa.nulls(1, pa.int64())]), "k2": pa.concat_arrays([rows.column(1), pa.nulls(1, pa.int64())]),
        **{name: pa.array([*totals[:, k].tolist(), None], pa.int64()) for k, name in enumerate(MEASURES)},
        "groups_sha256": pa.array([*digests, None], pa.string()), "groups": pa.array([*texts_of, None] if groups else [None] * (n + 1), pa.string()),
        "parts": pa.ListArray.from_arrays(pa.array([*bounds, bounds[-1]], pa.int32()), pa.array(code.astype(np.int32))),
        "pairs": last_only(n, pairs[used], pa.int64()), "weights": last_only(n, weights[used], pa.int64()),
        "part_pairs": last_only(n, np.searchsorted(used, local), pa.int32()), "part_sizes": last_only(n, sizes, pa.int32()),
    }
    return pa.RecordBatch.from_arrays([columns[name] for name in schema.names], schema=schema)


def last_only(n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``n`` empty lists, then ``values``."""
    return pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), pa.array(values).cast(kind))


def pair_counts(staged: DataFrame) -> DataFrame:
    """``pair, n, best``: documents that hold each linked id pair, and whether no pair of its A id has more.

    The highest counts are one row for each id of A, which the vocabulary bounds, so they are broadcast.
    """
    held = staged.where("k1 IS NULL").select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select("p.pairs", "p.weights")
    counts = stage(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("weights").alias("n")), "pair-counts")
    own = F.shiftright("pair", SHIFT)
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", own).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(staged: DataFrame, counts: DataFrame) -> DataFrame:
    """Measures of every text, with the sums over its links that need corpus-wide counts.

    A block's pairs and their counts meet its texts in one group; both are bounded by the block's bytes.
    """
    asked = staged.where("k1 IS NULL").select(F.col("block").alias("home"), F.explode("pairs").alias("pair")).join(counts, "pair")

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys = texts.column("k1").is_null().to_numpy()
        (at,) = np.flatnonzero(keys)
        head = texts.slice(at, 1)
        pairs, part_pairs, part_sizes = (head.column(c).combine_chunks().flatten().to_numpy() for c in ("pairs", "part_pairs", "part_sizes"))
        place = np.searchsorted(pairs, found.column("pair").to_numpy())
        value = np.zeros((len(pairs) + 1, 2), np.int64)  # the last for pairs of texts without tokens
        value[place, 0], value[place, 1] = found.column("best").to_numpy(zero_copy_only=False), found.column("n").to_numpy()
        ends = np.cumsum(part_sizes, dtype=np.int64)
        run = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(value[part_pairs], axis=0)])
        per_part = run[ends] - run[ends - part_sizes]
        rows = texts.filter(pa.array(~keys))
        parts = rows.column("parts").combine_chunks()
        stops = np.cumsum(np.diff(parts.offsets.to_numpy()), dtype=np.int64)
        run = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(per_part[parts.flatten().to_numpy()], axis=0)])
        sums = run[stops] - run[np.concatenate([[0], stops[:-1]]).astype(np.int64)]
        sums = sums * (rows.column("n_a").to_numpy() > 0)[:, None]
        out = rows.select([*KEY, *MEASURES, "groups_sha256", "groups"])
        return out.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1]))

    schema = "k1 long, k2 long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    return staged.groupBy("block").cogroup(asked.groupBy("home")).applyInArrow(work, schema)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row; with ``groups`` also the groups.

    A is a byte-level vocabulary read by ``tokenizers`` and sees the text with a space ahead; B is a byte-fallback piece
    model read by ``sentencepiece``, which puts that space itself. Texts that are null or empty, or whose tokens' bytes
    are not the text's, have zeros and an empty string. A pair's count is the number of rows whose text links it, so
    repeated rows and repeated ids count each; null ids are kept; other columns are ignored. An empty table gives none.
    """
    prepare(docs.sparkSession)
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    distinct = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    staged = stage(blocks(distinct, path_a, path_b, groups), "blocks")
    measured = stage(scored(staged, pair_counts(staged)), "measured")
    numbers = [*MEASURES, "n_best", "count_sum"]
    texts = ["groups_sha256", *(["groups"] if groups else [])]
    joined = docs.select("doc_id", *text_key()).join(measured, [*KEY], "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def pair_table(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``a, b, n, best``: the id pairs that the corpus links, by how many documents, and each A id's most frequent partners."""
    prepare(docs.sparkSession)
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    distinct = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    counts = pair_counts(stage(blocks(distinct, path_a, path_b, False), "blocks"))
    return counts.select(F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b"), "n", "best")
