"""Queries for the A family: sources, sinks, names."""

from __future__ import annotations

import struct

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from pulsegrid.catalog.registry import query
from pulsegrid.catalog.views import r, with_views
from pulsegrid.functions.rounding import rnd
from pulsegrid.operators import segments, tempo
from pulsegrid.session import new_path
from pulsegrid.sources import fixtures as fx
from pulsegrid.sources import files, media, sinks, text

EXT = ["mp4", "MOV", "txt", "webm", "Avi", "mkv", "jpg"]


def _files(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return fx.table(spark, sf, "part").select(
        F.concat(F.lit("media/"), F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path")
    )


FILES_SQL = (
    "files AS (SELECT 'media/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || "
    "['mp4','MOV','txt','webm','Avi','mkv','jpg'][p_partkey % 7 + 1] AS path FROM part)"
)


@query("a1_media_catalog", f"WITH {FILES_SQL} SELECT row_number() OVER (ORDER BY path) - 1 AS clip_id, path, "
       "lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4','avi','mov','mkv')")
def a1(spark, sf):
    return media.media_catalog(_files(spark, sf)).select("clip_id", "path", "ext")


@query("a1_media_catalog_gui", f"WITH {FILES_SQL} SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, count(*) AS n FROM files "
       "WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4','avi','mov','mkv','webm') GROUP BY 1")
def a1_gui(spark, sf):
    return media.media_catalog(_files(spark, sf), extensions=media.GUI_EXTENSIONS).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def _below(path, root):
    """The part of a listed path below ``root``."""
    return F.substring_index(path, f"/{root.rsplit('/', 1)[-1]}/", -1)


@query("a1_media_folder", f"WITH {FILES_SQL} SELECT row_number() OVER (ORDER BY path) - 1 AS clip_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, "
       "CAST(regexp_extract(path, '_(\\d+)\\.[^.]*$', 1) AS BIGINT) % 4 AS length FROM files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4','avi','mov','mkv')")
def a1_folder(spark, sf):
    root = new_path(spark, "media")
    content = F.expr("repeat('x', cast(regexp_extract(path, r'_(\\d+)\\.[^.]*$', 1) as int) % 4)")
    files.write_files(_files(spark, sf).select("path", content.alias("content")), root)
    found = media.media_catalog(media.list_files(spark, root))
    return found.select("clip_id", _below(F.col("path"), root).alias("path"), "ext", "length")


@query("a2_sample_blocks", with_views("samples", f"SELECT track_id, idx, {r('CAST(CAST(v AS FLOAT) AS DOUBLE)')} AS v FROM samples"))
def a2(spark, sf):
    path = new_path(spark, "blocks")
    media.to_blocks(fx.samples(spark, sf), rate=fx.RATE, block=512).write.parquet(path)
    return media.explode_blocks(media.read_blocks(spark, path)).select("track_id", "idx", rnd("v").alias("v"))


@query("a2_block_durations", with_views("samples", f"SELECT track_id, {r('count(*) / 200.0')} AS duration FROM samples GROUP BY track_id"))
def a2_dur(spark, sf):
    return media.block_durations(media.to_blocks(fx.samples(spark, sf), rate=fx.RATE, block=512)).select("track_id", rnd("duration").alias("duration"))


WAVE_FRAMES, WAVE_RANGE = 1500, 400


def _wave(values, rate):
    """A wave file of whole 32,768ths: 16-bit if all of them fit, 32-bit float with what is louder."""
    loud = bool(len(values)) and not (values.min() >= -32768 and values.max() <= 32767)
    tag, wide, body = (3, 4, (values / 32768).astype("<f4")) if loud else (1, 2, values.astype("<i2"))
    size = wide * len(values)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, tag, 1, rate, wide * rate, wide, 8 * wide, b"data", size) + body.tobytes()


def _write_waves(spark, sf, root):
    """Wave files of 1,500 samples of a track each, the last shorter."""
    rows = fx.samples(spark, sf).select("track_id", F.expr(f"idx div {WAVE_FRAMES}").alias("part"), "idx", F.floor(F.col("v") * 32768).cast("double").alias("pcm"))

    def work(table):
        content = _wave(table.sort_by("idx").column("pcm").to_numpy(), fx.RATE)
        name = f"{table.column('track_id')[0].as_py()}/{table.column('part')[0].as_py()}.wav"
        return pa.table({"path": [name.replace("/", "-", 1)], "content": pa.array([content], pa.binary())})

    return files.write_files(rows.groupBy("track_id", "part").applyInArrow(work, "path string, content binary"), root)


@query("a2_wave_ranges", with_views("samples", f"SELECT track_id || '-' || (idx // {WAVE_FRAMES}) || '.wav' AS track_id, (idx % {WAVE_FRAMES}) // 100 AS block_id, idx % {WAVE_FRAMES} AS idx, "
       "floor(v * 32768) / 32768 AS v FROM samples"))
def a2_waves(spark, sf):
    root = new_path(spark, "waves")
    _write_waves(spark, sf, root)
    blocks = media.ingest_wav(spark, root, block=100, range_frames=WAVE_RANGE)
    return media.explode_blocks(blocks).select("track_id", F.expr("idx div 100").alias("block_id"), "idx", "v")


DOC_BEATS = 64


def _beat_documents(spark, sf):
    """Beat JSON lines, a few of them deliberately broken, written as text."""
    b = fx.beats(spark, sf).withColumn("block", F.expr(f"beat_idx div {DOC_BEATS}"))
    docs = b.groupBy("track_id", "block").agg(F.array_sort(F.collect_list("t")).alias("beats"))
    kind = (F.col("track_id") + F.col("block")) % 7
    name = F.concat(F.lit("u"), F.col("track_id").cast("string"), F.lit("-"), F.col("block").cast("string"))
    good = F.to_json(F.struct(name.alias("track_id"), "beats", F.lit(120.0).alias("bpm"), F.array().cast("array<double>").alias("downbeats"), F.lit("grid").alias("backend")))
    failed = F.concat(F.lit('{"track_id":"'), name, F.lit('","error":"no model","beats":[],"bpm":null,"backend":null,"downbeats":[]}'))
    words = F.concat(F.lit('{"track_id":"'), name, F.lit('","beats":["soon"],"bpm":120.0}'))
    scalar = F.concat(F.lit('{"track_id":"'), name, F.lit('","beats":3,"bpm":120.0}'))
    line = F.when(kind == 0, failed).when(kind == 1, words).when(kind == 2, scalar).otherwise(good)
    path = new_path(spark, "beatjson")
    docs.select(line.alias("value")).write.text(path)
    return text.read_beat_json(spark, path)


@query("a3_beat_json", with_views("beats", f"SELECT 'u' || track_id || '-' || (beat_idx // 64) AS track_id, beat_idx % 64 AS beat_idx, {r('t')} AS t, 120.0 AS bpm "
       "FROM beats WHERE (track_id + beat_idx // 64) % 7 > 2"))
def a3(spark, sf):
    return text.json_beats(_beat_documents(spark, sf)).select("track_id", F.col("beat_idx").cast("long").alias("beat_idx"), rnd("t").alias("t"), "bpm")


@query("a3_beat_json_rejects", with_views("beats", "SELECT CASE k WHEN 0 THEN 'error payload' WHEN 1 THEN 'beat is not a number' ELSE 'beats is not a list' END AS reject, "
       "count(*) AS n FROM (SELECT DISTINCT track_id, beat_idx // 64 AS b, (track_id + beat_idx // 64) % 7 AS k FROM beats) WHERE k < 3 GROUP BY 1"))
def a3_rejects(spark, sf):
    return text.validate_beat_json(_beat_documents(spark, sf)).filter("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


def _spans(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ms = F.lit("yyyy-MM-dd HH:mm:ss.SSS")
    thread = F.concat(F.lit(" thread="), F.col("user_id").cast("string"))
    start = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" START "), F.col("event_type"), thread)
    end = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" END   "), F.col("event_type"), thread, F.lit(" duration="), F.floor("value").cast("string"), F.lit("ms"))
    lines = F.when(F.col("event_id") % 10 == 0, F.array(start)).otherwise(F.array(start, end))
    path = new_path(spark, "spans")
    e.select(F.explode(lines).alias("value")).write.text(path)
    return text.read_spans(spark, path)


@query("a4_span_log", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, kind, event_type AS name, CAST(user_id AS VARCHAR) AS thread, "
       "CASE WHEN kind = 'END' THEN CAST(floor(value) AS BIGINT) END AS duration_ms FROM events, (VALUES ('START'), ('END')) k(kind) WHERE kind = 'START' OR event_id % 10 <> 0")
def a4(spark, sf):
    return _spans(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "kind", "name", "thread", "duration_ms")


@query("d12_span_statistics", f"SELECT event_type AS name, count(*) FILTER (event_id % 10 <> 0) AS spans, count(*) FILTER (event_id % 10 = 0) AS open_spans, "
       f"{r('avg(floor(value)) FILTER (event_id % 10 <> 0)')} AS avg_ms, CAST(max(floor(value)) FILTER (event_id % 10 <> 0) AS BIGINT) AS max_ms FROM events GROUP BY 1")
def d12(spark, sf):
    return tempo.span_statistics(_spans(spark, sf)).select("name", "spans", "open_spans", rnd("avg_ms").alias("avg_ms"), "max_ms")


def _usage(spark, sf):
    e = fx.table(spark, sf, "events")
    path = new_path(spark, "usage")
    e.select((F.col("user_id") % 8).alias("i"), F.concat(F.lit("device "), (F.col("user_id") % 8).cast("string")), "value", F.col("value") * 10).write.csv(path)
    return text.read_usage(spark, path)


@query("a5_device_usage_csv", f"SELECT CAST(user_id % 8 AS BIGINT) AS \"index\", 'device ' || (user_id % 8) AS name, {r('value')} AS util, {r('value * 10')} AS mem_used FROM events")
def a5(spark, sf):
    return _usage(spark, sf).select(F.col("index").cast("long").alias("index"), "name", rnd("util").alias("util"), rnd("mem_used").alias("mem_used"))


@query("d13_device_usage", f"SELECT CAST(user_id % 8 AS BIGINT) AS \"index\", 'device ' || (user_id % 8) AS name, {r('max(value)')} AS max_util, {r('avg(value)')} AS avg_util, "
       f"{r('max(value * 10)')} AS max_mem, {r('avg(value * 10)')} AS avg_mem FROM events GROUP BY 1, 2")
def d13(spark, sf):
    d = tempo.device_usage(_usage(spark, sf))
    return d.select(F.col("index").cast("long").alias("index"), "name", *[rnd(c).alias(c) for c in ("max_util", "avg_util", "max_mem", "avg_mem")])


def _shader_texts(spark, sf):
    p = fx.table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("//  nAme:  "), F.col("p_name"), F.lit(" \t\n"))).otherwise(F.lit("// plain\n"))
    late = F.concat(F.repeat(F.lit("float x;\n"), 70), F.lit("// Category: too late\n"))
    cat = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("  // Category: first\n// category: "), F.lower("p_type"), F.lit("\n"))).otherwise(F.lit(""))
    return p.select(F.concat(F.lit("fx/p"), F.col("p_partkey").cast("string"), F.lit(".glsl")).alias("path"), F.concat(name, cat, late).alias("text"))


@query("a6_transition_catalog", "SELECT 'fx/p' || p_partkey || '.glsl' AS path, CASE WHEN p_partkey % 3 > 0 THEN trim(p_name) ELSE 'p' || p_partkey END AS name, "
       "CASE WHEN p_partkey % 5 > 0 THEN lower(p_type) ELSE 'unknown' END AS category FROM part")
def a6(spark, sf):
    return media.parse_transitions(_shader_texts(spark, sf)).select("path", "name", "category")


@query("a6_transition_folder", "SELECT 'p' || p_partkey || '.glsl' AS file, CASE WHEN p_partkey % 3 > 0 THEN trim(p_name) ELSE 'p' || p_partkey END AS name, "
       "CASE WHEN p_partkey % 5 > 0 THEN lower(p_type) ELSE 'unknown' END AS category FROM part")
def a6_folder(spark, sf):
    root = new_path(spark, "shaders")
    files.write_files(_shader_texts(spark, sf).select(F.substring_index("path", "/", -1).alias("path"), F.col("text").alias("content")), root)
    return media.read_transitions(spark, root).select(F.substring_index("path", "/", -1).alias("file"), "name", "category")


@query("a7_grid_report", with_views("beats", "SELECT track_id, beat_idx, printf('%.3f', t) AS text FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM beats) "
       "WHERE n <= 10 OR beat_idx < 5 OR beat_idx >= n - 5"))
def a7(spark, sf):
    return sinks.grid_report(fx.beats(spark, sf))


@query("a7_clock_report", with_views("beats", "SELECT track_id, beat_idx, printf('%2d:%6.3f', CAST(floor(t / 60) AS BIGINT), t - floor(t / 60) * 60) AS clock FROM beats WHERE beat_idx < 20"))
def a7_clock(spark, sf):
    return sinks.clock_report(fx.beats(spark, sf))


@query("a7_grid_sink", with_views("beats", f"SELECT track_id, count(*) AS n_beats, {r('max(t)')} AS duration FROM beats GROUP BY 1"))
def a7_sink(spark, sf):
    path = new_path(spark, "grid")
    sinks.write_grid(fx.beats(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_beats"), rnd(F.max("t")).alias("duration"))


@query("a8_edit_list_sink", with_views("beats", "SELECT track_id, 'file ''seg/' || track_id || '_' || lpad(CAST(beat_idx AS VARCHAR), 5, '0') || '.mp4''' AS line FROM beats"))
def a8(spark, sf):
    cuts = segments.cut_at_beats(fx.beats(spark, sf)).select(
        "track_id", F.col("beat_idx").alias("seg_no"), F.format_string("seg/%d_%05d.mp4", "track_id", "beat_idx").alias("path")
    )
    counts = fx.event_times(spark, sf).groupBy("track_id").agg(F.count("*").alias("n"))  # the file list comes from elsewhere
    listed = counts.withColumn("k", F.explode(F.expr("sequence(0L, n - 1)"))).select(F.format_string("seg/%d_%05d.mp4", "track_id", "k").alias("path"))
    written = sinks.write_edl(cuts, listed, new_path(spark, "edl"))
    return files.read_lines(written).select("track_id", "line")


CRC = (
    "WITH steps AS (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)), "
    "tbl AS (SELECT list(c ORDER BY i) AS t FROM steps), "
    "b AS (SELECT doc_id, octet_length(encode(text)) AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents) "
    "SELECT doc_id || '.txt' AS name, xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc32, CAST(size AS BIGINT) AS size FROM b, tbl"
)


@query("a8_edit_list_abort", with_views("beats", "SELECT track_id, count(*) AS n_missing, min(beat_idx) AS first_seg, 'seg/' || track_id || '_' || lpad(CAST(min(beat_idx) AS VARCHAR), 5, '0') || '.mp4' AS first_path, "
       "false AS written FROM beats WHERE track_id % 2 = 0 AND beat_idx % 7 = 3 GROUP BY track_id"))
def a8_abort(spark, sf):
    """Every seventh file of every second track is missing, so no track's list is written."""
    cuts = fx.beats(spark, sf).select("track_id", F.col("beat_idx").alias("seg_no"), F.format_string("seg/%d_%05d.mp4", "track_id", "beat_idx").alias("path"))
    listed = cuts.filter("track_id % 2 <> 0 OR seg_no % 7 <> 3").select("path")
    target = new_path(spark, "aborted")
    try:
        sinks.write_edl(cuts, listed, target)
    except sinks.EditListAborted as stop:
        store, inner, _ = files.open_store(target)
        return stop.missing.withColumn("written", F.lit(store.get_file_info(inner).type != pafs.FileType.NotFound))
    raise AssertionError("a list with missing files was written")


@query("a9_file_manifest", CRC)
def a9(spark, sf):
    d = fx.table(spark, sf, "documents")
    files = d.select(F.format_string("%s/%d.txt", "source", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return media.manifest(files)


FOLDER_CRC = CRC.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE coalesce(text, '') END AS text FROM documents))")


@query("a9_folder_manifest", FOLDER_CRC)
def a9_folder(spark, sf):
    """Texts as files, every fiftieth empty, read in ranges of 700 bytes."""
    root = new_path(spark, "texts")
    name = F.format_string("%s/%d.txt", F.coalesce("source", F.lit("none")), "doc_id")
    content = F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    files.write_files(fx.table(spark, sf, "documents").select(name.alias("path"), content.alias("content")), root)
    return media.read_manifest(spark, root, range_bytes=700)


@query("a10_segment_names", with_views("beats", "SELECT track_id, beat_idx, 'out/v' || track_id || '_seg' || beat_idx || CASE WHEN track_id % 2 = 0 THEN '.mov' ELSE '.mp4' END AS seg_name, "
       "'segment_' || lpad(CAST(beat_idx AS VARCHAR), 5, '0') || '.mp4' AS padded, printf('part-%03d.mp4', beat_idx) AS part FROM beats"))
def a10(spark, sf):
    b = fx.beats(spark, sf)
    out = F.concat(F.lit("out/v"), F.col("track_id").cast("string"), F.when(F.col("track_id") % 2 == 0, ".mov").otherwise(""))
    return b.select("track_id", "beat_idx", sinks.segment_name(out, F.col("beat_idx")).alias("seg_name"), sinks.padded_name(F.col("beat_idx")).alias("padded"),
                    sinks.pattern_name("part-%03d.mp4", F.col("beat_idx")).alias("part"))
