"""The prefix trie of conversations, by truncation peeling in strides.

A node is what conversations share up to one of their turns. All nodes are discovered by one grouping of turns by depth
and prefix digest, which the end of a conversation joins on its own depth. Then the trie is peeled from its maximum
depth: round k strips the last 2^k turns of every surviving node and regroups by the prefix that is left, so what lies
below a node has been gathered after a number of rounds that follows the logarithm of the depth. Nodes of a single
conversation have nothing to gather and do not survive the discovery.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare
from pulsegrid.operators.sequence import dense_index
from pulsegrid.session import stage

CHUNK = 8192  # turns of one conversation that one window sees
RUN_TEXT = 1 << 20  # characters of listed ids that travel as one row
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
NODE = ("depth", "x1", "x2")
SHARED_EVERY, OPENINGS = 100, 6


def digested(conversations: DataFrame) -> DataFrame:
    """``conv_id, idx`` (position from 0), ``k1, k2`` (128-bit digest of role and text) and ``chars`` of every turn.

    Turns are ordered by number, null first; turns of one number by their digest, so repeated rows stay turns of their
    own. Null roles and texts become empty. Rows without a conversation id belong to none and go. Positions come from a
    range sort, so one conversation may hold any share of all turns; texts do not travel.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    marks = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(3), text, role).alias("k2"), F.length(text).cast("long").alias("chars")
    )
    return stage(dense_index(marks, ["conv_id"], ["turn", "k1", "k2"], "idx").select("conv_id", "idx", "k1", "k2", "chars"), "turns")


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, k1, k2, chars, total`` and ``conv_id, total`` of conversations as they are; ``pos`` counts from 1."""
    convs = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), "conversations")
    return turns.join(convs, "conv_id").select("conv_id", (F.col("idx") + 1).alias("pos"), "k1", "k2", "chars", "total"), convs


def shared_openings(turns: DataFrame, every: int = SHARED_EVERY, kinds: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """As ``own_turns``, each conversation rebuilt: its first h turns become those of conversation ``c - c % every``.

    h is the CRC-32 of the decimal id modulo ``kinds``. If that conversation has fewer turns, all of them are taken, and
    none if it is absent; the own turns after the first h follow. A conversation may be left without any turn.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds
    first = F.col("conv_id") - F.col("conv_id") % every
    heads = stage(turns.where((F.col("conv_id") % every == 0) & (F.col("idx") < kinds - 1)).withColumnRenamed("conv_id", "first"), "heads")
    given = heads.groupBy("first").agg(F.count(F.lit(1)).alias("given"))
    convs = sizes.withColumns({"h": h, "first": first}).join(given, "first", "left").withColumn("lead", F.least("h", F.coalesce("given", F.lit(0))))
    convs = stage(convs.withColumn("total", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "first", "h", "lead", "total"), "conversations")
    tail = turns.join(convs, "conv_id").where("idx >= h").select("conv_id", (F.col("lead") + F.col("idx") - F.col("h") + 1).alias("pos"), "k1", "k2", "chars", "total")
    head = convs.join(heads, "first").where("idx < h").select("conv_id", (F.col("idx") + 1).alias("pos"), "k1", "k2", "chars", "total")
    return tail.unionByName(head), convs.select("conv_id", "total")


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``x1, x2``, the digest of the conversation up to the turn, and ``p1, p2``, that of one turn less.

    A prefix is the set of its (position, turn) pairs, so its digest is the exclusive or of theirs: chunks of a long
    conversation are digested apart and joined.
    """
    marked = turns.withColumns({"z1": F.xxhash64("pos", "k1", "k2"), "z2": F.xxhash64(F.lit(5), "k2", "k1", "pos"), "chunk": F.expr(f"(pos - 1) div {CHUNK}")})
    within = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({"l1": F.bit_xor("z1").over(within), "l2": F.bit_xor("z2").over(within)})
    long = marked.where(F.col("total") > CHUNK).groupBy("conv_id", "chunk").agg(F.bit_xor("z1").alias("t1"), F.bit_xor("z2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.select("conv_id", "chunk", F.bit_xor("t1").over(before).alias("o1"), F.bit_xor("t2").over(before).alias("o2")).where("o1 IS NOT NULL")
    joined = local.join(offsets, ["conv_id", "chunk"], "left")
    whole = {f"x{k}": _xor([F.col(f"l{k}"), F.coalesce(f"o{k}", F.lit(0).cast("long"))]) for k in (1, 2)}
    return joined.withColumns(whole).select(
        "conv_id", F.col("pos").alias("depth"), "x1", "x2", _xor([F.col("x1"), F.col("z1")]).alias("p1"), _xor([F.col("x2"), F.col("z2")]).alias("p2"), "chars", (F.col("pos") == F.col("total")).alias("ended")
    )


def discovered(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: key, parent's digest, smallest and number of members, and of the conversations that end there."""
    facts = [F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("ended"), 1)).alias("n_ends"), F.min(F.when(F.col("ended"), F.col("conv_id"))).alias("end_id")]
    nodes = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), *facts, F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("chars").alias("chars"))
    nought = F.lit(0).cast("long")
    root = convs.withColumn("ended", F.col("total") == 0).agg(F.min("conv_id").alias("conv_id"), *facts).where("n_convs > 0")
    root = root.select(nought.alias("depth"), nought.alias("x1"), nought.alias("x2"), "conv_id", "n_convs", "n_ends", "end_id", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), nought.alias("chars"))
    return nodes.unionByName(root)


def peel(shared: DataFrame) -> DataFrame:
    """``leaves`` and ``saved`` of ``shared`` nodes (``conv_id, depth, up_id, up_depth``) summed over each one's subtree.

    Before round k a node holds the sums of its subtree's first 2^k levels and the place of its prefix 2^k turns up.
    Stripping that many turns and regrouping adds to each prefix what its survivors hold; sums are partial before they
    are shuffled, so a prefix may have any number of survivors.
    """
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        gathered = shared.where("up_id IS NOT NULL").groupBy(F.col("up_id").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = shared.select(F.col("conv_id").alias("up_id"), F.col("depth").alias("up_depth"), F.col("up_id").alias("next_id"), F.col("up_depth").alias("next_depth"))
        grown = shared.join(gathered, ["conv_id", "depth"], "left").join(above, ["up_id", "up_depth"], "left")
        shared = stage(
            grown.select(
                "conv_id", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("next_id").alias("up_id"), F.col("next_depth").alias("up_depth"),
            ),
            "peeled",
        )
    return shared.select("conv_id", "depth", "leaves", "saved")


def listed_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of each node with more than one end, joined by commas: ``depth, x1, x2, ends_sha256``.

    A range sort spreads a node's ids over tasks, each of which writes its run as texts of up to ``RUN_TEXT`` characters;
    only those few rows meet, and are hashed one after the other as they come.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = "depth long, x1 long, x2 long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            ids = batch.column(3).to_numpy()
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
            words = list(map(str, ids.tolist()))
            most = max(1, RUN_TEXT // 21)
            cuts = [at for a, b in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(ids)], strict=True) for at in range(a, b, most)]
            rows = pa.array(cuts)
            texts = [",".join(words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(4)], pa.array(texts, pa.string())], names=["depth", "x1", "x2", "least", "ids"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def done() -> list:
            return [] if node is None else [(*node, digest.hexdigest())]

        for batch in batches:
            out = []
            for *key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key != node:
                    out += done()
                    node, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _hash_rows(out)
        yield _hash_rows(done())

    kind = ends.schema["conv_id"].dataType.simpleString()
    sorted_ends = ends.select(*NODE, "conv_id").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    runs = stage(sorted_ends.mapInArrow(write, f"{keys}, least {kind}, ids string"), "ends")
    return runs.repartition(parts, *NODE).sortWithinPartitions(*NODE, "least").mapInArrow(read, f"{keys}, ends_sha256 string")


def _hash_rows(rows: list) -> pa.RecordBatch:
    numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([r[3] for r in rows], pa.string())], names=["depth", "x1", "x2", "ends_sha256"])


def trie_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations whose turns (``conv_id, pos, k1, k2, chars, total``) and totals are given."""
    steps = stage(prefixes(turns), "prefixes")
    nodes = stage(discovered(steps, convs), "nodes")
    tops = nodes.where("n_convs > 1").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("top_id"))
    hung = stage(nodes.join(tops, ["depth", "p1", "p2"], "left"), "hung")

    below = hung.where("top_id IS NOT NULL").groupBy(F.col("top_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    below = below.agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("lone"))
    shared = hung.where("n_convs > 1").join(below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    shared = shared.select(
        "conv_id", "depth", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("lone")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.col("top_id").alias("up_id"), F.when(F.col("top_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
    )
    shared = stage(shared, "shared")
    summed = stage(peel(shared.drop("n_children")).join(shared.select("conv_id", "depth", "n_children"), ["conv_id", "depth"]), "summed")

    ended = steps.where("ended").select(*NODE, "conv_id").unionByName(
        convs.where("total = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id")
    )
    many = ended.join(nodes.where("n_ends > 1").select(*NODE), [*NODE])
    hashes = stage(listed_hashes(many), "hashes")

    full = hung.join(hashes, [*NODE], "left").join(summed, ["conv_id", "depth"], "left")
    alone = 1 - F.col("n_ends")  # children of a node with one member
    return full.select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("top_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", alone).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.when(F.col("n_ends") == 0, F.lit(EMPTY_HASH)).otherwise(F.sha2(F.col("end_id").cast("string"), 256))).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """One row per node of the trie of ``conversations`` (``conv_id, turn, role, text``), the root of depth 0 included.

    ``conv_id`` is the node's smallest member; with ``depth`` it names the node, and its turn of that number is the
    node's text. ``n_leaves`` and ``saved_tokens`` (code points that further members need not hold again) are sums over
    the subtree. With ``rebuilt`` conversations get ``shared_openings`` first. Other columns are ignored; an empty table
    has no node. Two turns are equal if role and text are, by 128-bit digests.
    """
    prepare(conversations.sparkSession)
    turns = digested(conversations)
    return trie_of(*(shared_openings(turns) if rebuilt else own_turns(turns)))
