"""Beat grids, edit lists, segment names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.rounding import printf
from pulsegrid.operators.sequence import with_stats
from pulsegrid.session import stage
from pulsegrid.sources.files import write_lines


def write_grid(beats: DataFrame, path: str) -> None:
    """Sorted by track and time inside each file, so that range filters can skip row groups."""
    beats.repartitionByRange("track_id", "t").sortWithinPartitions("track_id", "t").write.parquet(path)


def grid_report(beats: DataFrame, *, edge: int = 5, full: int = 10) -> DataFrame:
    """The beats a text report shows: all up to ten, else the first and last five."""
    sized = with_stats(beats, ["track_id"], n=F.count(F.lit(1)))
    shown = (F.col("n") <= full) | (F.col("beat_idx") < edge) | (F.col("beat_idx") >= F.col("n") - edge)
    return sized.filter(shown).select("track_id", "beat_idx", printf("%.3f", F.col("t")).alias("text"))


def clock_text(t: Column) -> Column:
    """Minutes and seconds."""
    minutes = F.floor(t / 60)
    return printf("%2d:%6.3f", minutes, t - minutes * 60)


def clock_report(beats: DataFrame, *, first: int = 20) -> DataFrame:
    """The first beats of each track as min:sec (a top-k report)."""
    return beats.filter(F.col("beat_idx") < first).select("track_id", "beat_idx", clock_text(F.col("t")).alias("clock"))


class EditListAborted(FileNotFoundError):
    """Segments of an edit list have no file; ``missing`` lists them by track."""

    def __init__(self, count: int, missing: DataFrame):
        super().__init__(f"{count} segment files are missing")
        self.missing = missing


def checked_edl(segments: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of an edit list, each with whether its file is ``missing`` from the listing, written once for check and write.

    A null path is missing; files listed twice count once.
    """
    listed = files.select("path").distinct().withColumn("_there", F.lit(True))
    joined = segments.select("track_id", "seg_no", "path").join(listed, "path", "left")
    line = F.format_string("file '%s'", "path").alias("line")
    return stage(joined.select("track_id", "seg_no", "path", line, F.col("_there").isNull().alias("missing")), "edl")


def missing_segments(checked: DataFrame) -> DataFrame:
    """(track_id, n_missing, first_seg, first_path) of tracks whose edit list cannot be written."""
    absent = checked.filter("missing").groupBy("track_id")
    return absent.agg(F.count(F.lit(1)).alias("n_missing"), F.min("seg_no").alias("first_seg"), F.min_by("path", "seg_no").alias("first_path"))


def write_edl(segments: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Any missing file aborts the write of all tracks, before anything is written. One directory per track, lines in order.

    The input is planned and run once: check and write read the same written lines. ``_SUCCESS`` in ``path`` marks a list
    that is whole. Tasks name their files themselves, so the driver neither moves nor lists the directories of the tracks;
    returns ``track_id, path`` of the files.
    """
    checked = checked_edl(segments, files)
    absent = checked.filter("missing").count()
    if absent:
        raise EditListAborted(absent, missing_segments(checked))
    # a hot track spreads over range partitions; part files of a track keep the order by name
    lines = checked.repartitionByRange("track_id", "seg_no").sortWithinPartitions("track_id", "seg_no")
    return write_lines(lines, "track_id", path)


def segment_name(stem: Column, number: Column, extension: str = ".mp4") -> Column:
    """A10: ``<out>_seg<N><ext>``; the extension of the output name is kept, else the default is used."""
    dot = F.regexp_extract(stem, r"(\.[^.]*)$", 1)
    base = F.regexp_replace(stem, r"\.[^.]*$", "")
    return F.concat(base, F.lit("_seg"), number.cast("string"), F.when(dot == "", F.lit(extension)).otherwise(dot))


def padded_name(number: Column, prefix: str = "segment_") -> Column:
    """A10: five-digit zero-padded name."""
    return F.format_string(f"{prefix}%05d.mp4", number)


def pattern_name(pattern: str, number: Column) -> Column:
    """A10: printf pattern with one integer."""
    return F.format_string(pattern, number)
