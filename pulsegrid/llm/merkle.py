"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import borders, bucket_of

SECTION = 16  # paragraphs of a section
PIECE = r"[^.!?\n]{1,80}[.!?\n]*+|[.!?\n]+"  # a sentence, or 80 characters of one; pieces leave nothing out
SHORT = 8  # hex digits of a section's digest that the fingerprint shows


def tree(text: Column) -> Column:
    """Struct ``root``, ``sections`` (digests), ``paragraphs`` (digests), ``pieces`` (32-bit hashes); null counts as empty.

    A paragraph is a line and its digest the SHA-256 of its text. A section is ``SECTION`` paragraphs in a row, digested
    over theirs, and the root is digested over the sections. Pieces are finer than paragraphs; they measure likeness.
    """
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))
    return F.struct(paragraphs.alias("paragraphs"), F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.hash(p)).alias("pieces"))


def with_tree(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add the tree of a text column as struct ``out``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(f"{out}.paragraphs") - 1) / SECTION).cast("int"))
    sections = F.transform(starts, lambda k: F.sha2(F.array_join(F.slice(f"{out}.paragraphs", k * SECTION + 1, SECTION), ""), 256))
    return (
        docs.withColumn(out, tree(F.col(text)))
        .withColumn(out, F.struct(sections.alias("sections"), f"{out}.paragraphs", f"{out}.pieces"))
        .withColumn(out, F.struct(F.sha2(F.array_join(f"{out}.sections", ""), 256).alias("root"), f"{out}.sections", f"{out}.paragraphs", f"{out}.pieces"))
    )


def fingerprint(tree: str) -> Column:
    """The tree as text: root, the sections' digests in short, the pieces in hex."""
    sections = F.array_join(F.transform(f"{tree}.sections", lambda d: F.substring(d, 1, SHORT)), "")
    pieces = F.array_join(F.transform(f"{tree}.pieces", lambda h: F.right(F.lpad(F.hex(h), 8, "0"), F.lit(8))), "")
    return F.concat_ws(":", f"{tree}.root", sections, pieces)


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else the shared part of the different pieces of two trees (Dice)."""
    shared = F.size(F.array_intersect(f"{a}.pieces", f"{b}.pieces"))
    both = F.size(F.array_distinct(f"{a}.pieces")) + F.size(F.array_distinct(f"{b}.pieces"))
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0).otherwise(F.coalesce(2.0 * shared / F.nullif(both, F.lit(0)), F.lit(0.0)))


def changed_paragraphs(a: str, b: str) -> Column:
    """Numbers (from 0) of the paragraphs in which two trees differ; only branches with different digests are opened."""
    most = F.greatest(F.size(f"{a}.sections"), F.size(f"{b}.sections"))
    differ = F.filter(F.sequence(F.lit(0), most - 1), lambda k: ~F.get(f"{a}.sections", k).eqNullSafe(F.get(f"{b}.sections", k)))
    inside = F.transform(
        differ,
        lambda k: F.filter(F.sequence(k * SECTION, k * SECTION + SECTION - 1), lambda p: ~F.get(f"{a}.paragraphs", p).eqNullSafe(F.get(f"{b}.paragraphs", p))),
    )
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), F.array().cast("array<int>")).otherwise(F.flatten(inside))


def ranges(rows: DataFrame, order: str, tie: Column, buckets: int | None = None) -> DataFrame:
    """Deal rows to ranges of ``order`` (a long without nulls), so that each row's successor is in its own range.

    Adds ``_range``, ``_tie`` and ``_real``. The row that follows a range by descending order, the first of the range
    below (of the highest for the lowest), is repeated at its end with ``_real`` 0. So nothing is sorted as one.
    """
    spark = rows.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = borders(rows, order, buckets)
    if cuts and rows.where(F.col(order) < cuts[0]).isEmpty():
        cuts = cuts[1:]  # every range holds a row now
    dealt = rows.withColumn("_range", bucket_of(F.col(order), cuts)).withColumn("_tie", tie)
    heads = dealt.groupBy("_range").agg(F.max(order).alias("_head"))
    first = dealt.join(F.broadcast(heads), "_range").where(F.col(order) == F.col("_head")).drop("_head")  # a row per range, but for ties
    own = Window.partitionBy("_range").orderBy("_tie")
    ends = first.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    ends = ends.withColumn("_range", F.when(F.col("_range") == len(cuts), 0).otherwise(F.col("_range") + 1))
    return dealt.withColumn("_real", F.lit(1)).unionByName(ends.withColumn("_real", F.lit(0)))


def with_next(ranged: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` from the following row by descending ``order`` to rows dealt by ``ranges``."""
    inside = Window.partitionBy("_range").orderBy(F.desc("_real"), F.desc(order), "_tie")
    kept = [c for c in ranged.columns if c not in ("_range", "_tie")]
    return ranged.select(*kept, *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns]).where("_real = 1").drop("_real")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text keeps the first half of the code points and takes the other half from the start of the next document
    by descending ``doc_id`` (after the last: the first). Null texts count as empty, null ids come last, rows of equal
    ids follow each other by their text. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("order"))
    ranged = with_tree(ranges(rows, "order", F.xxhash64("text")), "text", "tree")
    ranged = ranged.withColumn("tree", F.struct("tree.root", "tree.sections", "tree.pieces"))
    pairs = with_next(ranged, "order", ["text", "tree"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = with_tree(pairs.withColumn("edited", edited).drop("next_text"), "edited", "edited_tree")
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("tree").alias("fingerprint"),
        fingerprint("edited_tree").alias("edited_fingerprint"),
        likeness("tree", "edited_tree").alias("near_edited"),
        likeness("tree", "next_tree").alias("near_next"),
    )
