"""Folders as tables, files by byte range.

A folder is listed by tasks, one for each of its branches, so paths never pass through the driver and files of length 0
are rows like others. File content is read by ranges, so a file of any size spreads over tasks and none holds more than
a piece of one. Paths are what ``pyarrow.fs`` reads: local folders, HDFS and the common object stores.
"""

from __future__ import annotations

import fnmatch
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsegrid.session import stage

SHARDS = 256  # branches that a listing is cut into, about
LISTED = 10_000  # rows of one batch
PIECE = 1 << 20  # bytes of a file that a task holds at once
HEAD = 16 << 10  # bytes read at once of a file whose first lines are wanted
RANGE = 64 << 20  # bytes of a file that one task reads
RANGE_FRAMES = 1 << 22
POLYNOMIAL = np.uint32(0xEDB88320)  # fixed: of CRC-32, lowest bit first


def open_store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, the path inside it, and what to put before inner paths to name them in full."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/").rstrip("/"), "file:"
    store, inner = pafs.FileSystem.from_uri(path)
    scheme, _, rest = path.partition("://")
    head = f"{scheme}://{rest.split('/', 1)[0]}" if inner.startswith("/") else f"{scheme}://"  # object stores name the bucket in the path
    return store, inner.rstrip("/") or "/", head


@dataclass
class Branch(InputPartition):
    folder: str
    deep: bool  # with all folders below, or its own files only


def entries(store: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool, int | None]]:
    """Path, name, whether it is a folder, and size of what lies in a folder; a local folder is not held whole."""
    if not isinstance(store, pafs.LocalFileSystem):
        for e in store.get_file_info(pafs.FileSelector(folder)):
            if e.type in (pafs.FileType.Directory, pafs.FileType.File):
                yield e.path, e.base_name, e.type == pafs.FileType.Directory, e.size
        return
    with os.scandir(folder) as found:
        for e in found:
            if e.is_dir():
                yield e.path, e.name, True, None
            elif e.is_file():
                yield e.path, e.name, False, e.stat().st_size


class FolderReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, shards: int, below: bool):
        self.path, self.pattern, self.shards, self.below = path, pattern, shards, below

    def partitions(self) -> list[Branch]:
        """Branches of the tree: folders are opened level by level until there are enough; only their names are held."""
        store, root, _ = open_store(self.path)
        if store.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.path}")
        if not self.below:
            return [Branch(root, False)]
        opened, waiting = [], [root]
        while waiting and len(opened) + len(waiting) < self.shards:
            level = waiting[: self.shards]
            waiting = waiting[self.shards :]
            for folder in level:
                opened.append(folder)
                waiting += [path for path, name, is_folder, _ in entries(store, folder) if is_folder and shown(name)]
        return [*(Branch(f, False) for f in opened), *(Branch(f, True) for f in waiting)]

    def read(self, partition: Branch) -> Iterator[pa.RecordBatch]:
        store, _, head = open_store(self.path)
        waiting, paths, sizes = [partition.folder], [], []
        while waiting:
            for path, name, is_folder, size in entries(store, waiting.pop()):
                if is_folder:
                    if partition.deep and shown(name):
                        waiting.append(path)
                elif shown(name) and fnmatch.fnmatchcase(name, self.pattern):
                    paths.append(head + path)
                    sizes.append(size)
                if len(paths) == LISTED:
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(sizes, pa.int64())})
                    paths, sizes = [], []
        if paths:
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(sizes, pa.int64())})


def shown(name: str) -> bool:
    """Names that Spark's own readers do not pass over."""
    return not name.startswith(("_", "."))


class FolderSource(DataSource):
    """``format("folder")``: path and length of every file of a folder and the folders below."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("shards", SHARDS)), self.options.get("below", "true") == "true")


def list_folder(spark: SparkSession, folder: str, pattern: str = "*", shards: int = SHARDS, below: bool = True) -> DataFrame:
    """``path, length`` of every file below ``folder`` whose name fits the shell pattern ``pattern``; of the folder's own files only without ``below``.

    Tasks list the branches; the driver sees folder names of the first levels only. A missing folder is an error, an
    empty one gives no rows. Names that start with ``_`` or ``.`` are passed over.
    """
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("pattern", pattern).option("shards", shards).option("below", below).load(folder)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of every row to the file ``path`` below ``folder``; ``path, length`` of what was written.

    A file is written under another name and then renamed, so a task that runs twice leaves whole files. Null content
    makes an empty file. Rows of one path overwrite each other. Rows are dealt anew, so a small table of many files
    does not leave one task to write them all.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, _ = open_store(folder)
        known: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{root}/{path}"
                above, _, name = target.rpartition("/")
                if above not in known:
                    store.create_dir(above, recursive=True)
                    known.add(above)
                with store.open_output_stream(f"{above}/.{name}.part") as out:
                    out.write(content or b"")
                store.move(f"{above}/.{name}.part", target)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "length": pa.array(sizes, pa.int64())})

    dealt = rows.select("path", F.col("content").cast("binary")).repartition("path")
    return stage(dealt.mapInArrow(work, "path string, length long"), "written")


def read_heads(files: DataFrame, lines: int) -> DataFrame:
    """``path, text`` of every file of ``files``: its first ``lines`` lines as UTF-8. Little past them is read."""

    def packed(paths: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "text": pa.array(texts, pa.string())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, size = [], [], 0
            for path in batch.column(0).to_pylist():
                store, inner, _ = open_store(path)
                with store.open_input_stream(inner) as source:
                    held = [source.read(HEAD)]
                    seen = held[0].count(b"\n")
                    while seen < lines and (more := source.read(HEAD)):
                        held.append(more)
                        seen += more.count(b"\n")
                head = b"\n".join(b"".join(held).split(b"\n", lines)[:lines])
                paths.append(path)
                texts.append(head.decode("utf-8", "replace"))
                size += len(head)
                if size >= PIECE:
                    yield packed(paths, texts)
                    paths, texts, size = [], [], 0
            if paths:
                yield packed(paths, texts)

    return files.select("path").repartition("path").mapInArrow(work, "path string, text string")


def folder_name(key: str, value: object) -> str:
    """The folder of one value of a partition column, as Spark names and reads it."""
    if value is None:
        return f"{key}=__HIVE_DEFAULT_PARTITION__"
    return f"{key}=" + re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", str(value))


def write_lines(lines: DataFrame, key: str, folder: str) -> DataFrame:
    """Write sorted partitions of ``key, line`` as text, one folder per ``key``; ``key, path`` of every file.

    A task goes through its rows once and has one file open. An empty key is null. Files of a key follow each other by name in the order of the
    partitions. A file is written under another name and then renamed; ``_SUCCESS`` is written last, when all are there.
    """
    store, root, head = open_store(folder)
    if store.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} exists")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root, _ = open_store(folder)
        part = TaskContext.get().partitionId()
        kind = None
        now, out, target = None, None, ""
        keys, paths = [], []

        def close() -> None:
            out.close()
            above, _, name = target.rpartition("/")
            store.move(f"{above}/.{name}", target)
            keys.append(now)
            paths.append(head + target)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            own = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, names = own.indices.to_numpy(), own.dictionary.to_pylist()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                value = None if names[codes[a]] == "" else names[codes[a]]  # as Spark does, so both share a file
                if out is None or value != now:
                    if out is not None:
                        close()
                    above = f"{root}/{folder_name(key, value)}"
                    store.create_dir(above, recursive=True)
                    now, target = value, f"{above}/part-{part:05d}.txt"
                    out = store.open_output_stream(f"{above}/.part-{part:05d}.txt")
                out.write("".join(f"{line}\n" for line in batch.column(1).slice(a, b - a).to_pylist()).encode("utf-8", "surrogatepass"))
            if len(paths) >= LISTED:
                yield pa.RecordBatch.from_pydict({key: pa.array(keys, kind), "path": pa.array(paths, pa.string())})
                keys.clear()
                paths.clear()
        if out is not None:
            close()
            yield pa.RecordBatch.from_pydict({key: pa.array(keys, kind), "path": pa.array(paths, pa.string())})

    written = stage(lines.select(key, "line").mapInArrow(work, T.StructType([lines.schema[key], T.StructField("path", T.StringType())])), "written")
    store.create_dir(root, recursive=True)
    store.open_output_stream(f"{root}/_SUCCESS").close()
    return written


def read_lines(files: DataFrame) -> DataFrame:
    """``files`` once for each line of the text at ``path``, with the ``line``; a task holds a piece of a file and a line."""
    fields = [f for f in files.schema if f.name != "line"]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            lines: list[str] = []
            size = 0

            def packed() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(lines, pa.string())], names=[*names, "line"])
                rows.clear()
                lines.clear()
                return made

            for k, path in enumerate(batch.column(names.index("path")).to_pylist()):
                store, inner, _ = open_store(path)
                with store.open_input_stream(inner) as source:
                    rest = b""
                    while piece := source.read(PIECE):
                        *whole, rest = (rest + piece).split(b"\n")
                        lines += [x.decode("utf-8", "replace") for x in whole]
                        rows += [k] * len(whole)
                        size += len(piece)
                        if size >= PIECE and rows:
                            yield packed()
                            size = 0
                    if rest:
                        lines.append(rest.decode("utf-8", "replace"))
                        rows.append(k)
            if rows:
                yield packed()

    return files.select(*names).repartition("path").mapInArrow(work, T.StructType([*fields, T.StructField("line", T.StringType())]))


def ranges_of(files: DataFrame, length: str, step: int) -> DataFrame:
    """``files`` once for each range of ``step``: ``begin`` and ``end``; none where ``length`` is 0. Ranges are dealt anew, so a long file spreads."""
    cut = files.where(F.col(length) > 0).withColumn("begin", F.explode(F.expr(f"sequence(0L, {length} - 1, {step}L)")))
    return cut.withColumn("end", F.least(F.col("begin") + step, F.col(length))).repartition("path", "begin")


def zero_bytes_operators(steps: int = 64) -> np.ndarray:
    """Images of the 32 bits of a CRC under 2^k appended zero bytes, for each k."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):  # one bit at a time
        bits = (bits >> np.uint32(1)) ^ np.where(bits & 1, POLYNOMIAL, np.uint32(0))
    out = [bits]
    for _ in range(steps - 1):
        out.append(np.array([applied(out[-1], int(b)) for b in out[-1]], np.uint32))
    return np.array(out)


def applied(operator: np.ndarray, crc: int) -> int:
    """The image of ``crc``: the exclusive or of its bits' images."""
    return int(np.bitwise_xor.reduce(operator[np.flatnonzero((crc >> np.arange(32)) & 1)], initial=0))


def shifted(crc: int, after: int, operators: np.ndarray) -> int:
    """What ``crc`` adds to the CRC of a file in which ``after`` more bytes follow."""
    for k in range(after.bit_length()):
        if after >> k & 1:
            crc = applied(operators[k], crc)
    return crc


def checksums(files: DataFrame, step: int = RANGE) -> DataFrame:
    """``path, length, crc32`` of every file: ranges are read apart, and what each adds is joined by exclusive or.

    The CRC of two strings in a row is the first's, moved over the second's length, exclusive or the second's. So tasks
    hold ``PIECE`` bytes, a file of any length is read by many, and one row a range is all that is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        operators = zero_bytes_operators()
        for batch in batches:
            out = []
            for path, length, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner, _ = open_store(path)
                crc = 0
                with store.open_input_file(inner) as source:
                    source.seek(begin)
                    while begin < end:
                        piece = source.read(min(PIECE, end - begin))
                        if not piece:
                            raise OSError(f"{path} ends before byte {end}")
                        crc, begin = zlib.crc32(piece, crc), begin + len(piece)
                out.append(shifted(crc, length - end, operators))
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "part": pa.array(out, pa.int64())})

    parts = ranges_of(files, "length", step).select("path", "length", "begin", "end").mapInArrow(work, "path string, part long")
    whole = parts.groupBy("path").agg(F.bit_xor("part").alias("part"))
    return files.join(whole, "path", "left").select("path", "length", F.coalesce("part", F.lit(0).cast("long")).alias("crc32"))


HEADERS = "path string, length long, sample_rate int, channels int, kind string, data_at long, frames long, reject string"
DECODED = {  # fixed: stored type, value of silence and full scale of each sample format
    "u1": ("u1", 128.0, 128.0), "i2": ("<i2", 0.0, 32768.0), "i3": (None, 0.0, 8388608.0), "i4": ("<i4", 0.0, 2147483648.0),
    "f4": ("<f4", 0.0, 1.0), "f8": ("<f8", 0.0, 1.0),
}


def parse_header(source, length: int) -> dict:
    """Format and place of the samples of a RIFF or RF64 wave file; ``reject`` says why there are none.

    A data chunk that claims more than the file holds, or whose length was never filled in, ends with the file.
    """
    head = source.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return {"reject": "not a wave file"}
    found: dict = {}
    wide = None
    at = 12
    while at + 8 <= length:
        source.seek(at)
        name, size = struct.unpack("<4sI", source.read(8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", source.read(16))[1]
        elif name == b"fmt ":
            body = source.read(min(size, 40))
            if len(body) < 16:
                return {"reject": "broken format chunk"}
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == 0xFFFE and len(body) >= 26:
                (tag,) = struct.unpack("<H", body[24:26])
            kind = {(1, 8): "u1", (1, 16): "i2", (1, 24): "i3", (1, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((tag, bits))
            if kind is None or not channels or not rate:
                return {"reject": f"format {tag} of {bits} bits, {channels} channels at {rate} is not read"}
            found |= {"sample_rate": rate, "channels": channels, "kind": kind}
        elif name == b"data":
            if "kind" not in found:
                return {"reject": "samples before their format"}
            given = wide if size == 0xFFFFFFFF and wide is not None else size
            held = length - at - 8
            given = held if given > held or size == 0xFFFFFFFF and wide is None else given
            return found | {"data_at": at + 8, "frames": given // (int(found["kind"][1]) * found["channels"])}
        at += 8 + size + size % 2
    return {"reject": "no samples"}


def wave_headers(files: DataFrame) -> DataFrame:
    """One row per file of ``files`` (``path, length``): sample format and place; ``reject`` instead for what is no wave file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in HEADERS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner, _ = open_store(path)
                with store.open_input_file(inner) as source:
                    rows.append({"path": path, "length": length} | parse_header(source, length))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return files.select("path", "length").mapInArrow(work, HEADERS)


def decoded(raw: bytes, kind: str) -> np.ndarray:
    """Samples between -1 and 1."""
    stored, silence, scale = DECODED[kind]
    if stored is None:  # three bytes a sample: the upper three of four
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        values = (wide.view("<i4").ravel() >> 8).astype(np.float64)
    else:
        values = np.frombuffer(raw, stored).astype(np.float64)
    return ((values - silence) / scale).astype(np.float32)


def read_waves(spark: SparkSession, folder: str, *, block: int = 65_536, range_frames: int = RANGE_FRAMES) -> DataFrame:
    """A2: sample blocks of every ``*.wav`` file (any case) below ``folder``, by ranges of frames.

    ``track_id`` (file name), ``block_id, start_idx`` (of interleaved values), ``sample_rate, channels, samples``. A range
    is a whole number of blocks, so blocks do not depend on ``range_frames``; a task holds one block at a time. A file
    that is no wave file, or of a format that is not read, is an error when its row is met; ``wave_headers`` tells which.
    """
    headers = stage(wave_headers(list_folder(spark, folder, "*.[wW][aA][vV]")), "headers")
    step = -(-range_frames // block) * block
    good = ranges_of(headers.where("reject IS NULL").drop("length"), "frames", step)
    bad = headers.where("reject IS NOT NULL").select(F.raise_error(F.concat("path", F.lit(": "), "reject")).cast("string").alias("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner, _ = open_store(row["path"])
                wide = int(row["kind"][1]) * row["channels"]
                with store.open_input_file(inner) as source:
                    for first in range(row["begin"], row["end"], block):
                        count = min(block, row["end"] - first)
                        source.seek(row["data_at"] + first * wide)
                        values = decoded(source.read(count * wide), row["kind"])
                        yield pa.RecordBatch.from_pydict({
                            "track_id": [inner.rsplit("/", 1)[-1]], "block_id": pa.array([first // block], pa.int64()), "start_idx": pa.array([first * row["channels"]], pa.int64()),
                            "sample_rate": pa.array([row["sample_rate"]], pa.int32()), "channels": pa.array([row["channels"]], pa.int32()),
                            "samples": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)),
                        })

    blocks = good.select("path", "sample_rate", "channels", "kind", "data_at", "begin", "end").mapInArrow(work, "track_id string, block_id long, start_idx long, sample_rate int, channels int, samples array<float>")
    none = bad.select(F.col("path").alias("track_id"), *[F.lit(None).cast(kind).alias(name) for name, kind in (("block_id", "long"), ("start_idx", "long"), ("sample_rate", "int"), ("channels", "int"), ("samples", "array<float>"))])
    return blocks.unionByName(none)
