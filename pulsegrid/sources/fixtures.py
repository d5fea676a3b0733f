"""Track-shaped views over the shared test tables.

They give the operators realistic inputs (see FIXTURES.md): event times act as beats,
event values as a sampled signal, embedding vectors as signal frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.sequence import dense_index

RATE = 200  # nominal samples per second
BLOCK = 100  # samples per stream chunk
EPOCH_MICROS = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
SECONDS_PER_UNIT = 76_800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        as_utc = F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())
        return F.unix_micros(as_utc)
    return F.unix_micros(F.col(name))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    t = (micros(events, "ts") - F.lit(EPOCH_MICROS)) / F.lit(1e6) / F.lit(SECONDS_PER_UNIT)
    return events.select(F.col("user_id").alias("track_id"), "event_id", F.col("event_type").alias("stem"), "value", t.alias("t"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_times(spark, sf_dir).select("track_id", "t", "event_id")
    return dense_index(rows, ["track_id"], ["t", "event_id"], "beat_idx").select("track_id", "beat_idx", "t")


def stem_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_times(spark, sf_dir).select("track_id", "stem", "t", "event_id")
    return dense_index(rows, ["track_id", "stem"], ["t", "event_id"], "beat_idx").select("track_id", "stem", "beat_idx", "t")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("track_id"), "event_id", ((F.col("value") - 50) / 500).alias("v")
    )
    return dense_index(events, ["track_id"], ["event_id"], "idx").select("track_id", "idx", "v")


def stem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal split into four stems per track by user."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("track_id"), (F.col("user_id") % 4).alias("stem"), "event_id", ((F.col("value") - 50) / 500).alias("v")
    )
    return dense_index(events, ["track_id", "stem"], ["event_id"], "idx").select("track_id", "stem", "idx", "v")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("track_id"), "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )
    return dense_index(vectors, ["track_id"], ["vec_id"], "frame_idx").select("track_id", "frame_idx", "x")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_times(spark, sf_dir).groupBy("track_id").agg((F.max("t") + 1.0).alias("duration"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per (type, size): the catalogue stays small however large ``part`` grows."""
    parts = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("copies"))
    paths = parts.select(
        F.format_string("clips/%s_%02d.mp4", F.lower("p_type"), F.col("p_size")).alias("path"),
        (F.col("p_size") / 10.0).alias("duration"),
        "copies",
    )
    return dense_index(paths.withColumn("_all", F.lit(0)), ["_all"], ["path"], "clip_id").select(
        "clip_id", "path", "duration", "copies"
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") % 30).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.expr("o_custkey div 10").alias("track_id"),
        F.col("o_orderkey").alias("region_id"),
        F.col("o_orderpriority").alias("effect"),
        start.alias("start_s"),
        (start + 1.0 + (F.col("o_orderkey") % 5)).alias("end_s"),
        (F.col("o_orderstatus") != "P").alias("enabled"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected beat times: each beat moved by 10, 30 or 50 ms."""
    shift = 0.01 + 0.02 * (F.col("beat_idx") % 3)
    moved = beats(spark, sf_dir).select("track_id", "beat_idx", (F.col("t") + shift).alias("t"))
    return dense_index(moved, ["track_id"], ["t", "beat_idx"], "truth_idx").select("track_id", "truth_idx", "t")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("chunk_no", F.expr(f"idx div {BLOCK}"))
    return rows.groupBy("track_id", "chunk_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda s: s["v"]).alias("samples")
    )
