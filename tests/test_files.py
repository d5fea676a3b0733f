"""Folders as tables, files by range."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from pulsegrid.sources import files, media


def tree(tmp_path):
    """Nested folders with files of many sizes, empty ones included, and names that are passed over."""
    rng = random.Random(5)
    content = {}
    for folder in ("", "a", "a/b", "a/b/c d", "e", "e/f"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for size in (0, 1, 6, 7, 8, 700, rng.randint(1, 3000)):
            name = f"{folder}/{size}.bin".lstrip("/")
            content[name] = rng.randbytes(size)
            (tmp_path / name).write_bytes(content[name])
    (tmp_path / "empty").mkdir()
    (tmp_path / ".hidden").write_bytes(b"x")
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp/y.bin").write_bytes(b"y")
    return content


@pytest.mark.parametrize("shards", [1, 3, files.SHARDS])
def test_listing(spark, tmp_path, shards):
    content = tree(tmp_path)
    rows = files.list_folder(spark, str(tmp_path), shards=shards).collect()
    assert sorted((r.path, r.length) for r in rows) == sorted((f"file:{tmp_path}/{n}", len(c)) for n, c in content.items())
    assert files.list_folder(spark, f"file:{tmp_path}/a", "7*", shards).count() == sum(n.startswith("a/") and n.rsplit("/", 1)[-1].startswith("7") for n in content)
    assert files.list_folder(spark, str(tmp_path / "empty"), shards=shards).count() == 0
    with pytest.raises(Exception, match="no folder"):
        files.list_folder(spark, str(tmp_path / "absent")).count()


@pytest.mark.parametrize("step", [1 << 20, 700, 7])
def test_checksums_by_range(spark, tmp_path, step):
    content = tree(tmp_path)
    rows = files.checksums(files.list_folder(spark, str(tmp_path)), step).collect()
    assert {r.path.removeprefix(f"file:{tmp_path}/"): (r.length, r.crc32) for r in rows} == {n: (len(c), zlib.crc32(c)) for n, c in content.items()}


def test_crc_of_far_ranges():
    """Ranges far from a file's end, against bytes that are really there."""
    operators = files.zero_bytes_operators()
    head, tail = b"first part", b"\x00" * 5_000_001
    assert files.shifted(zlib.crc32(head), len(tail), operators) ^ zlib.crc32(tail) == zlib.crc32(head + tail)
    assert files.shifted(files.shifted(77, 3 << 40, operators), 5, operators) == files.shifted(77, (3 << 40) + 5, operators)


def riff(tag, bits, channels, rate, data, *, extensible=False, claim=None, before=b"", wide=None):
    body = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        body += struct.pack("<HHIH", 22, bits, 0, tag) + b"\x00" * 14
    ds = b"" if wide is None else b"ds64" + struct.pack("<IQQQI", 28, 0, wide, 0, 0)
    return (b"RIFF" if wide is None else b"RF64") + b"\xff\xff\xff\xff" + b"WAVE" + ds + b"fmt " + struct.pack("<I", len(body)) + body + before + b"data" + struct.pack("<I", len(data) if claim is None else claim) + data


def test_blocks_are_the_same_for_every_range(spark, tmp_path):
    rng = np.random.default_rng(3)
    pcm = rng.integers(-32768, 32768, 2 * 5001).astype("<i2")
    (tmp_path / "s.WAV").write_bytes(riff(1, 16, 2, 44_100, pcm.tobytes(), before=b"LIST" + struct.pack("<I", 3) + b"abc\x00"))
    taken = []
    for step in (1, 300, 1000, 1 << 22):
        rows = media.ingest_wav(spark, str(tmp_path), block=300, range_frames=step).orderBy("block_id").collect()
        assert [r.block_id for r in rows] == list(range(17)) and [r.start_idx for r in rows] == [600 * k for k in range(17)]
        assert {(r.track_id, r.sample_rate, r.channels) for r in rows} == {("s.WAV", 44_100, 2)}
        taken.append(np.concatenate([r.samples for r in rows]))
    assert all((t == taken[0]).all() for t in taken)
    np.testing.assert_array_equal(taken[0], (pcm / 32768).astype(np.float32))


def test_sample_formats_and_odd_files(spark, tmp_path):
    want = np.array([0.0, 0.5, -0.5, -1.0, 0.25])
    three = b"".join(int(v * 8388608).to_bytes(3, "little", signed=True) for v in want)
    forms = {
        "u1": riff(1, 8, 1, 8000, (want * 128 + 128).astype("u1").tobytes()), "i2": riff(1, 16, 1, 8000, (want * 32768).astype("<i2").tobytes()),
        "i3": riff(1, 24, 1, 8000, three), "i4": riff(1, 32, 1, 8000, (want * 2**31).astype("<i4").tobytes(), extensible=True),
        "f4": riff(3, 32, 1, 8000, want.astype("<f4").tobytes()), "f8": riff(3, 64, 1, 8000, want.astype("<f8").tobytes(), extensible=True),
        "open": riff(1, 16, 1, 8000, (want * 32768).astype("<i2").tobytes(), claim=0xFFFFFFFF), "long": riff(1, 16, 1, 8000, (want * 32768).astype("<i2").tobytes() + b"\x01", claim=5000),
        "rf64": riff(1, 16, 1, 8000, (want * 32768).astype("<i2").tobytes() + b"next", claim=0xFFFFFFFF, wide=10), "none": riff(1, 16, 1, 8000, b""),
    }
    for name, raw in forms.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    got = {}
    for r in media.explode_blocks(media.ingest_wav(spark, str(tmp_path), block=2)).orderBy("track_id", "idx").collect():
        got.setdefault(r.track_id.removesuffix(".wav"), []).append(r.v)
    assert got == {name: want.tolist() for name in forms if name != "none"}

    for name, raw in {"bad": b"RIFX" + b"\x00" * 40, "short": b"RIFF", "mu": riff(7, 8, 1, 8000, b"abc"), "empty": b"", "bare": riff(1, 16, 1, 8000, b"")[:36]}.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    rejects = {r.path.rsplit("/", 1)[1]: r.reject for r in files.wave_headers(files.list_folder(spark, str(tmp_path))).collect()}
    assert {n for n, why in rejects.items() if why} == {"bad.wav", "short.wav", "mu.wav", "empty.wav", "bare.wav"}
    with pytest.raises(Exception, match="wav: "):
        media.ingest_wav(spark, str(tmp_path)).collect()


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("x/1.txt", b"one"), ("x/2.txt", None), ("3.txt", b"")], "path string, content binary")
    assert {(r.path, r.length) for r in files.write_files(rows, str(tmp_path)).collect()} == {("x/1.txt", 3), ("x/2.txt", 0), ("3.txt", 0)}
    assert (tmp_path / "x/1.txt").read_bytes() == b"one" and (tmp_path / "x/2.txt").read_bytes() == b""
