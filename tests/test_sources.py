"""Readers and writers on small files made here."""

from __future__ import annotations

import json
import wave
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from pulsegrid.operators import tempo
from pulsegrid.sources import files, media, sinks, text
from tests.compare import difference


def write_wav(path, values, rate=8000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(values, dtype="<i2").tobytes())


def test_wav_ingest(spark, tmp_path):
    mono, stereo = np.arange(-500, 500), np.arange(600)
    write_wav(tmp_path / "m.wav", mono)
    write_wav(tmp_path / "s.wav", stereo, channels=2)
    blocks = media.ingest_wav(spark, str(tmp_path), block=128).cache()
    rows = media.explode_blocks(blocks).toPandas().sort_values(["track_id", "idx"])
    np.testing.assert_allclose(rows[rows.track_id == "m.wav"].v, mono / 32768, atol=1e-7)
    np.testing.assert_allclose(rows[rows.track_id == "s.wav"].v, stereo / 32768, atol=1e-7)
    lasting = {r.track_id: r.duration for r in media.block_durations(blocks).collect()}
    assert lasting == {"m.wav": 1000 / 8000, "s.wav": 300 / 8000}
    declared = spark.createDataFrame([("m.wav", 9.0), ("s.wav", 0.0)], "track_id string, duration double")
    assert {r.track_id: r.duration for r in media.block_durations(blocks, declared).collect()} == {"m.wav": 9.0, "s.wav": 300 / 8000}


def test_media_listing(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "c.txt", "d.webm", "noext"):
        (tmp_path / name).write_bytes(b"" if name == "b.MP4" else b"x")
    files = media.list_files(spark, str(tmp_path))
    cli = media.media_catalog(files).orderBy("clip_id").toPandas()
    assert [p.rsplit("/", 1)[1] for p in cli.path] == ["a.mkv", "b.MP4"]
    assert media.media_catalog(files, extensions=media.GUI_EXTENSIONS).count() == 3


def test_transitions(spark, tmp_path):
    (tmp_path / "fade.glsl").write_text("// Category: blend\n// Name: fade\nvoid main() {}\n")
    (tmp_path / "x.glsl").write_text("//NAME: one\n// name: two words \t\n" + "\n" * 70 + "// Category: late\n")
    (tmp_path / "plain.glsl").write_text("void main() {}\n")
    got = {r.path.rsplit("/", 1)[1]: (r.name, r.category) for r in media.read_transitions(spark, str(tmp_path)).collect()}
    assert got == {"fade.glsl": ("fade", "blend"), "x.glsl": ("two words", "unknown"), "plain.glsl": ("plain", "unknown")}
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        media.read_transitions(spark, str(tmp_path / "empty"))


def test_many_transitions_are_listed_and_read_by_tasks(spark, tmp_path):
    """Neither the paths nor a partition for each few files is held by the driver; heads longer than a piece are whole."""
    for k in range(300):
        (tmp_path / f"t {k}.glsl").write_bytes(b"// " + b"x" * (200 * k) + b"\r\n" * (62 + k % 2) + f"// Name: n\u00fc{k}\r\n".encode() + b"// Name: late\n" * 3)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "no.glsl").write_text("// Name: below\n")
    (tmp_path / ".t.glsl").write_text("")
    (tmp_path / "bare.glsl").write_text("")
    made = media.read_transitions(spark, str(tmp_path))
    assert not [f for f in made.inputFiles() if f.endswith(".glsl")]
    got = {r.path.rsplit("/", 1)[1]: r.name for r in made.collect()}
    want = {f"t {k}.glsl": f"n\u00fc{k}" if k % 2 else "late" for k in range(300)}
    assert got == want | {"bare.glsl": "bare"}


def test_manifest(spark, tmp_path):
    for name, body in (("a.txt", b"hello"), ("b.bin", bytes(range(256))), ("empty", b"")):
        (tmp_path / name).write_bytes(body)
    got = {r.name: (r.crc32, r["size"]) for r in media.read_manifest(spark, str(tmp_path)).collect()}
    assert got == {n: (zlib.crc32(b), len(b)) for n, b in (("a.txt", b"hello"), ("b.bin", bytes(range(256))), ("empty", b""))}


def test_beat_json(spark, tmp_path):
    good = {"track_id": "g", "beats": [0.5, 1, 1.5], "bpm": 120.0, "downbeats": [0.5], "backend": "x"}
    bad = [{"track_id": "e", "error": "no", "beats": [], "bpm": None}, {"track_id": "m", "bpm": 1}, {"track_id": "l", "beats": "soon"}, {"track_id": "n", "beats": [1, "x"]}]
    lines = [json.dumps(d) for d in [good, *bad]] + ["{broken"]
    (tmp_path / "b.json").write_text("\n".join(lines))
    docs = text.read_beat_json(spark, str(tmp_path)).cache()
    rejects = sorted(r.reject for r in text.validate_beat_json(docs).collect() if r.reject)
    assert rejects == ["beat is not a number", "beats is not a list", "error payload", "no beats", "not json"]
    assert [(r.beat_idx, r.t) for r in text.json_beats(docs).orderBy("beat_idx").collect()] == [(0, 0.5), (1, 1.0), (2, 1.5)]


def test_spans_and_usage(spark, tmp_path):
    (tmp_path / "spans.log").write_text(
        "2024-05-01 10:00:00.120 START load thread=7\n2024-05-01 10:00:00.150 END   load thread=7 duration=30ms\n"
        "noise\n2024-05-01 10:00:01.000 START load thread=8\n2024-05-01 10:00:02.000 START two words thread=7\n2024-05-01 10:00:02.010 END   two words thread=7 duration=10ms\n"
    )
    spans = text.read_spans(spark, str(tmp_path / "spans.log"))
    assert spans.count() == 5
    assert spans.filter("name = 'load' AND kind = 'END'").first().duration_ms == 30
    out = {r.name: (r.spans, r.open_spans, r.avg_ms) for r in tempo.span_statistics(spans).collect()}
    assert out == {"load": (1, 1, 30.0), "two words": (1, 0, 10.0)}
    (tmp_path / "u.csv").write_text("0, Card A, 10, 100\n0, Card A, 30, 300\n1, Card B, 5, 50\n")
    use = {r["index"]: (r.name, r.max_util, r.avg_mem) for r in tempo.device_usage(text.read_usage(spark, str(tmp_path / "u.csv"))).collect()}
    assert use == {0: ("Card A", 30.0, 200.0), 1: ("Card B", 5.0, 50.0)}


def test_edit_list_write_stops_on_missing_files(spark, tmp_path):
    segs = spark.createDataFrame(pd.DataFrame({"track_id": 1, "seg_no": [0, 1], "path": ["a.mp4", "b.mp4"]}))
    with pytest.raises(FileNotFoundError):
        sinks.write_edl(segs, segs.filter("seg_no = 0").select("path"), str(tmp_path / "none"))
    with pytest.raises(sinks.EditListAborted) as stop:
        sinks.write_edl(segs, segs.filter("seg_no = 0").select("path"), str(tmp_path / "none"))
    assert [tuple(r) for r in stop.value.missing.select("n_missing", "first_seg", "first_path").collect()] == [(1, 1, "b.mp4")]
    assert not (tmp_path / "none").exists()
    sinks.write_edl(segs, segs.select("path"), str(tmp_path / "edl"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "edl")).collect()]
    assert lines == ["file 'a.mp4'", "file 'b.mp4'"]


def test_edit_lists_of_many_tracks(spark, tmp_path):
    """Files are named by the tasks, one folder a track as Spark names it, and no folder is listed to read them again."""
    names = ["a/b", "100%", "x=1", "it's", "", None, "é"] + [f"t{k}" for k in range(200)]
    rows = [(t, k, f"{t}_{k}.mp4") for t in names for k in range(3)] + [("long", k, f"l{k}\t.mp4") for k in range(30_000)]
    segs = spark.createDataFrame(rows, "track_id string, seg_no long, path string").repartition(5)
    written = sinks.write_edl(segs, segs.select("path"), str(tmp_path / "edl"))
    assert written.groupBy("track_id").count().count() == len(names) and (tmp_path / "edl" / "_SUCCESS").exists()
    want = sorted(((t or None, f"file '{p}'") for t, _, p in rows), key=str)
    assert sorted(((r.track_id, r.line) for r in files.read_lines(written).collect()), key=str) == want
    back = spark.read.schema("value string, track_id string").text(str(tmp_path / "edl"))
    assert sorted(((r.track_id, r.value) for r in back.collect()), key=str) == want
    parts = sorted((tmp_path / "edl" / "track_id=long").iterdir())
    assert "".join(p.read_text() for p in parts) == "".join(f"file 'l{k}\t.mp4'\n" for k in range(30_000))
    with pytest.raises(FileExistsError):
        sinks.write_edl(segs, segs.select("path"), str(tmp_path / "edl"))
    none = sinks.write_edl(segs.limit(0), segs.select("path"), str(tmp_path / "none"))
    assert none.count() == 0 and (tmp_path / "none" / "_SUCCESS").exists()


def test_waves_of_loud_tracks(spark, tmp_path):
    """Values above 550 do not fit 16 bits; a quiet file of the same track stays 16-bit."""
    values = [50.0 + 0.3 * (k % 7) for k in range(1_600)]
    values[1_510:1_513] = [560.21, 90_000.0, -700.5]
    rows = spark.createDataFrame([(k, "a", v) for k, v in enumerate(values)] + [(9_000, "b", 560.21)], "event_id long, event_type string, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = queries()["a2_wave_ranges"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert difference(got, con.execute(oracle_sql()["a2_wave_ranges"]).df()) is None
