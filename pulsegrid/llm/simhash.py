"""SimHash fingerprints and exact search of near ones through vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare, row_runs, text_slices, unburdened
from pulsegrid.llm.components import components
from pulsegrid.session import stage

SHINGLE = 3
SEED = 42
DISTANCE = 3
SHARD = 4_000  # fingerprints of a shard, about
SAMPLE = 40_000  # fingerprints that shape the tree of shards, at most
MAX_DEPTH = 12  # of the tree of shards; larger tables have larger shards, which are searched by trees of their own
BRUTE = 256  # a node of so many fingerprints is compared directly


def fingerprint_texts(texts: list[str], words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of whole texts over word shingles, as unsigned integers."""
    digest = xxhash.xxh64_digest
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[tuple[int, int]] = []

    def count() -> None:
        if not held:
            return
        rows = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8)
        bits = np.unpackbits(rows, axis=1)
        sizes = np.array([n for _, n in owners], np.int64)
        sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
        np.add.at(ones, [k for k, _ in owners], sums)
        held.clear()
        owners.clear()

    for k, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").lower().split()
        if not own:
            continue
        joined = b" ".join(own)
        stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])
        wide = min(words, len(own))
        first, last = starts[: len(own) - wide + 1].tolist(), stops[wide - 1 :].tolist()
        total[k] = len(first)
        for at in range(0, len(first), 100_000):
            hashes = [digest(joined[a:b], seed) for a, b in zip(first[at : at + 100_000], last[at : at + 100_000], strict=True)]
            held += hashes
            owners.append((k, len(hashes)))
            if len(held) >= 100_000:
                count()
    count()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def set_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHashes of ``words`` times 64 bits of sets of 64-bit shingle hashes, none of them empty; one row of words a set."""
    mask, factor = np.random.default_rng(SEED).integers(0, 1 << 63, (2, words), np.uint64)
    out = np.empty((len(sets), words), np.uint64)
    for k, own in enumerate(sets):
        ones = np.zeros(words * 64, np.int64)
        for at in range(0, len(own), 255):  # so many bits add up in a byte
            value = (own[at : at + 255, None] ^ mask) * (factor | np.uint64(1))
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
            ones += np.unpackbits(value.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * ones > len(own)).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and signed 64-bit ``fp`` of every row. Null and empty texts and texts without a word have 0."""

    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                found = fingerprint_texts(texts.to_pylist(), words, seed)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "fp": pa.array(found.view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(unburdened(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@dataclass
class Node:
    """Inner node of a vantage-point tree, or a leaf with its number."""

    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inner: "Node | None" = None
    outer: "Node | None" = None
    leaf: int = -1


def distance(point: np.uint64, fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def choose(fps: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point whose distances spread widely, and their median."""
    seen = fps if len(fps) <= 2_000 else fps[rng.integers(0, len(fps), 2_000)]
    best = max((fps[k] for k in rng.integers(0, len(fps), 8)), key=lambda p: float(distance(p, seen).std()))
    return best, int(np.median(distance(best, seen)))


def shard_tree(fps: np.ndarray, depth: int) -> tuple[Node, int]:
    """A tree over sampled fingerprints with at most ``2 ** depth`` leaves, and their number."""
    rng, leaves = np.random.default_rng(11), 0

    def grow(own: np.ndarray, left: int) -> Node:
        nonlocal leaves
        if left and len(own) > 8:
            point, radius = choose(own, rng)
            near = distance(point, own) <= radius
            if 0 < near.sum() < len(own):
                return Node(point, radius, grow(own[near], left - 1), grow(own[~near], left - 1))
        leaves += 1
        return Node(leaf=leaves - 1)

    return grow(fps, depth), leaves


def route(tree: Node, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """For every leaf the rows at home there, then the rows that have to look for neighbours there.

    A row is at home in one leaf. Two rows within ``reach`` that are parted at a node are found on its outer side: only
    the inner row crosses, and only where the triangle inequality lets its ball meet the outer side. A row that has
    crossed looks into every further side that its ball meets.
    """
    todo = [(tree, np.arange(len(fps)), np.zeros(0, np.int64))]
    while todo:
        node, home, guests = todo.pop()
        if not len(home) and not len(guests):
            continue
        if node.inner is None:
            yield node.leaf, home, True
            yield node.leaf, guests, False
            continue
        d = distance(node.point, fps[home]).astype(np.int64)
        near = d <= node.radius
        e = distance(node.point, fps[guests]).astype(np.int64)
        todo.append((node.inner, home[near], guests[e - reach <= node.radius]))
        crossing = home[near & (d + reach > node.radius)]
        todo.append((node.outer, home[~near], np.concatenate([crossing, guests[e + reach > node.radius]])))


class Forest:
    """Union-find over array positions."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
        self.root = root


def link_shard(fps: np.ndarray, home: np.ndarray, reach: int = DISTANCE) -> np.ndarray:
    """Smallest position of each row's linked group in one shard; a link needs a row at home there.

    A local tree splits the home rows further, with the same rule for rows near the border; small or inseparable nodes
    are compared directly, in blocks.
    """
    forest, rng = Forest(len(fps)), np.random.default_rng(5)
    at_home = np.flatnonzero(home)
    todo = [(at_home, np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own) or len(own) + len(guests) < 2:
            continue
        if len(own) > BRUTE:
            point, radius = choose(fps[own], rng)
            d, e = distance(point, fps[own]).astype(np.int64), distance(point, fps[guests]).astype(np.int64)
            near = d <= radius
            if 0 < near.sum() < len(own):
                todo.append((own[near], guests[e - reach <= radius]))
                crossing = own[near & (d + reach > radius)]
                todo.append((own[~near], np.concatenate([crossing, guests[e + reach > radius]])))
                continue
        every = np.concatenate([own, guests])
        step = max(1, (1 << 20) // len(own))
        for k in range(0, len(every), step):
            part = every[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[own][None, :]) <= reach)
            forest.join(part[i], own[j])
    return forest.root


def near_links(distinct: DataFrame, reach: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Links ``a, b`` between representatives whose fingerprints differ in at most ``reach`` bits.

    ``distinct`` has one row ``fp, rep`` for each fingerprint. Each shard gives a spanning forest of its links, so a
    dense group costs as many rows as it has members; together the forests connect what the links connect.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    share = max(1, total // SAMPLE)
    drawn = distinct.where(F.pmod(F.xxhash64(F.lit(3), F.col("fp")), F.lit(share)) == 0).select("fp").limit(2 * SAMPLE)
    sample = np.array(sorted(r[0] for r in drawn.collect()), np.int64).view(np.uint64)
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / shard))))
    tree, leaves = shard_tree(sample, depth)
    rep = distinct.schema["rep"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for leaf, rows, home in route(tree, fps, reach):
                if len(rows):
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_pydict(
                        {"leaf": pa.array(np.full(len(rows), leaf, np.int32)), "fp": batch.column(0).take(taken), "rep": batch.column(1).take(taken), "home": pa.array(np.full(len(rows), home))}
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_runs(batches, "leaf"):
            leaf = rows.column("leaf").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = rows.slice(a, b - a)
                root = link_shard(own.column("fp").to_numpy().view(np.uint64), own.column("home").to_numpy(zero_copy_only=False), reach)
                moved = np.flatnonzero(root != np.arange(len(root)))
                ends = own.column("rep").combine_chunks()
                yield pa.RecordBatch.from_pydict({"a": ends.take(pa.array(moved)), "b": ends.take(pa.array(root[moved]))})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leaves / 8))
    dealt = distinct.select("fp", "rep").mapInArrow(deal, f"leaf int, fp long, rep {rep}, home boolean")
    return dealt.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(search, f"a {rep}, b {rep}")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, reach: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Rows of equal fingerprints are one node of the link graph, so exact copies cost nothing. ``component_id`` is the
    smallest ``doc_id`` reachable over links, itself included. A row with a null id is fingerprinted and gets the
    component of its fingerprint; if only rows with null ids are there, that is null. Repeated rows stay.
    """
    marked = stage(fingerprints(docs, words), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "distinct")
    linked = components(near_links(distinct, reach))
    named = stage(distinct.join(linked, distinct["rep"] == linked["id"], "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "named")
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
