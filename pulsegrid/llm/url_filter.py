"""URL rules by a sort-merge range join: prefixes become intervals, a sorted sweep keeps the nested open rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import borders, bucket_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LAST = "\U0010ffff" * 4  # sorts after everything that starts with the same key


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def key_of(labels: Column, depth: Column, path: Column) -> Column:
    """The last ``depth`` host labels from the right, then the path: ``org.example//es/1``. No host holds a slash."""
    return F.concat(F.array_join(F.slice(F.reverse(labels), 1, depth), "."), F.lit("/"), path)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", buckets: int | None = None) -> DataFrame:
    """Verdict of the longest fitting rule for every page: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and all subdomains where the page's path starts
    with the rule's. Among fitting rules the longest text (host and path) wins, then the longer host; of one rule given
    twice, ``block`` wins. Without a fitting rule the verdict is ``default`` and ``rule`` is null. A null url, or one
    without ``://``, has empty host and path. Rows are kept one for one; other columns are ignored.

    Each different address is judged once: it takes a key for every host depth that rules have. Keys and rules are dealt
    to key ranges; a rule goes to all ranges that its interval meets, so every range can be swept on its own.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = (
        rules.where("host IS NOT NULL AND host <> ''")
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("verdict"))
        .withColumn("depth", F.size(F.split("host", r"\.")))
    )
    depths = sorted(r[0] for r in known.select("depth").distinct().collect())
    addresses = listed.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    asked = (
        addresses.withColumn("depth", F.explode(F.filter(F.array(*[F.lit(d) for d in depths] or [F.lit(0)]), lambda d: (d > 0) & (d <= F.size(labels)))))
        .select("host", "path", key_of(labels, F.col("depth"), F.col("path")).alias("key"))
    )
    cuts = borders(asked, "key", buckets)
    key = key_of(labels, F.col("depth"), F.col("path"))
    first, last = bucket_of(F.col("key"), cuts), bucket_of(F.concat("key", F.lit(LAST)), cuts)
    opened = (
        known.withColumn("key", key)
        .withColumn("bucket", F.explode(F.sequence(first, last)))
        .select("bucket", "key", F.lit(0).alias("kind"), "host", "path", "verdict")
    )
    events = opened.unionByName(asked.select(first.alias("bucket"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict")))
    dealt = events.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "kind")
    found = dealt.mapInArrow(sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    best = found.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("best")
    )
    return listed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass over sorted keys; the stack holds the rules whose interval is open, the innermost on top."""
    stack: list[tuple[str, str, str, str]] = []
    current = None
    for batch in batches:
        hits: list[tuple[str, str, str, str, str]] = []
        for bucket, key, kind, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != current:
                current, stack = bucket, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host, path, verdict))
            elif stack:
                hits.append((host, path, *stack[-1][1:]))
        columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
        names = ["host", "path", "rule_host", "rule_path", "verdict"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)
