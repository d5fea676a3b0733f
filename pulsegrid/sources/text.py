"""A3-A5: beat JSON, span logs, device-usage CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEAT_JSON = "track_id string, beats string, bpm double, downbeats array<double>, backend string, error string, audio string, _bad string"
USAGE = "index int, name string, util double, mem_used double"


def read_beat_json(spark: SparkSession, path: str) -> DataFrame:
    """A3: one document per line; ``beats`` stays text so that its type can be checked."""
    return (
        spark.read.schema(BEAT_JSON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
        .withColumn("path", F.input_file_name())
    )


def validate_beat_json(documents: DataFrame) -> DataFrame:
    """A3: adds ``times`` and ``reject`` (null for a good document)."""
    raw = F.from_json("beats", "array<string>")
    times = F.transform(raw, lambda x: x.try_cast("double"))
    reject = (
        F.when(F.col("_bad").isNotNull(), "not json")
        .when(F.col("error").isNotNull(), "error payload")
        .when(F.col("beats").isNull(), "no beats")
        .when(~F.col("beats").startswith("["), "beats is not a list")
        .when(F.exists(times, lambda x: x.isNull()), "beat is not a number")
    )
    return documents.withColumn("times", times).withColumn("reject", reject)


def json_beats(documents: DataFrame) -> DataFrame:
    """A3: good documents as beats."""
    good = validate_beat_json(documents).filter(F.col("reject").isNull())
    return good.select("track_id", "bpm", "backend", F.posexplode("times").alias("beat_idx", "t"))


def parse_spans(lines: DataFrame) -> DataFrame:
    """A4: START and END lines with millisecond timestamps; other lines are dropped."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}) (START|END)\s+(.+?) thread=(\S+)(?: duration=(\d+)ms)?\s*$"

    def part(i: int):
        return F.regexp_extract("value", pattern, i)

    return lines.filter(F.col("value").rlike(pattern)).select(
        F.to_timestamp_ntz(part(1), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("kind"), part(3).alias("name"), part(4).alias("thread"),
        F.when(part(5) != "", part(5).cast("long")).alias("duration_ms"),
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return parse_spans(spark.read.text(path))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """A5: headerless index,name,util,mem_used."""
    return spark.read.schema(USAGE).option("ignoreLeadingWhiteSpace", "true").csv(path)
