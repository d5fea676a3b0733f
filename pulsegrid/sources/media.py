"""Media listings, sample blocks, transition files, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.sequence import dense_index
from pulsegrid.session import stage
from pulsegrid.sources import files

CLI_EXTENSIONS = ["mp4", "avi", "mov", "mkv"]  # fixed values
GUI_EXTENSIONS = [*CLI_EXTENSIONS, "webm"]
HEADER_LINES = 64
BLOCKS = T.StructType([
    T.StructField("track_id", T.StringType()), T.StructField("block_id", T.LongType()), T.StructField("start_idx", T.LongType()),
    T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path and length of every file, empty ones included; tasks list the folders and nothing is read."""
    return files.list_folder(spark, folder, pattern)


def media_catalog(listed: DataFrame, *, extensions: list[str] | None = None) -> DataFrame:
    """A1: files with a media extension in any case, numbered in path order."""
    kept = listed.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).filter(F.col("ext").isin(extensions or CLI_EXTENSIONS))
    ranked = dense_index(kept.withColumn("_all", F.lit(0)), ["_all"], ["path"], "clip_id")
    return ranked.drop("_all")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A2: Parquet sample blocks."""
    return spark.read.schema(BLOCKS).parquet(path)


def to_blocks(samples: DataFrame, *, rate: int, block: int = 65_536, channels: int = 1) -> DataFrame:
    """A2: pack (track_id, idx, v) into blocks of at most ``block`` values."""
    packed = samples.groupBy("track_id", F.expr(f"idx div {block}").alias("block_id")).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s"))
    return packed.select(
        "track_id", "block_id", (F.col("block_id") * block).alias("start_idx"), F.lit(rate).alias("sample_rate"), F.lit(channels).alias("channels"),
        F.transform("s", lambda x: x["v"].cast("float")).alias("samples"),
    )


def explode_blocks(blocks: DataFrame) -> DataFrame:
    """A2: (track_id, idx, v); interleaved channels keep their running index."""
    rows = blocks.select("track_id", "start_idx", F.posexplode("samples").alias("pos", "v"))
    return rows.select("track_id", (F.col("start_idx") + F.col("pos")).alias("idx"), F.col("v").cast("double").alias("v"))


def block_durations(blocks: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """A2: declared duration when positive, else samples over rate."""
    own = blocks.groupBy("track_id").agg((F.sum(F.size("samples")) / F.max(F.col("sample_rate") * F.col("channels"))).alias("_own"))
    if declared is None:
        return own.select("track_id", F.col("_own").alias("duration"))
    joined = own.join(declared, "track_id", "left")
    return joined.select("track_id", F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.col("_own")).alias("duration"))


def ingest_wav(spark: SparkSession, folder: str, *, block: int = 65_536, range_frames: int = files.RANGE_FRAMES) -> DataFrame:
    """A2: wave files to sample blocks, by ranges of frames in parallel tasks."""
    return files.read_waves(spark, folder, block=block, range_frames=range_frames)


def read_transitions(spark: SparkSession, folder: str, *, header_lines: int = HEADER_LINES) -> DataFrame:
    """The transition catalogue of a folder, without the folders below; an empty folder is an error.

    A task lists it and others read the first lines of its files: neither paths nor texts pass through the driver.
    """
    listed = stage(files.list_folder(spark, folder, "*.glsl", below=False), "transitions")
    if listed.isEmpty():
        raise ValueError(f"no transition files in {folder}")
    return parse_transitions(files.read_heads(listed, header_lines), header_lines=header_lines)


def parse_transitions(texts: DataFrame, *, header_lines: int = HEADER_LINES) -> DataFrame:
    """Name and category from the header, by rule the first 64 lines; last match wins; defaults are the file stem and 'unknown'."""
    lines = F.slice(F.split("text", "\r?\n"), 1, header_lines)

    def tag(label: str):
        pattern = rf"(?i)^\s*//\s*{label}:\s*(.+)\s*$"
        last = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(-1))
        return F.regexp_replace(F.regexp_extract(last, pattern, 1), r"^\s+|\s+$", "")

    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return texts.select("path", F.coalesce(tag("Name"), stem).alias("name"), F.coalesce(tag("Category"), F.lit("unknown")).alias("category"))


def base_name(path: str | Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def manifest(contents: DataFrame) -> DataFrame:
    """Base name, CRC-32 and size of ``contents(path, content)``."""
    return contents.select(base_name("path").alias("name"), F.crc32("content").alias("crc32"), F.octet_length("content").cast("long").alias("size"))


def read_manifest(spark: SparkSession, folder: str, *, range_bytes: int = files.RANGE) -> DataFrame:
    """Base name, CRC-32 and size of every file below ``folder``, of any size; files are read by ranges."""
    return files.checksums(list_files(spark, folder), range_bytes).select(base_name("path").alias("name"), "crc32", F.col("length").alias("size"))
