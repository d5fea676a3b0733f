"""The stateful stream against the same samples in one piece."""

from __future__ import annotations

import time

import numpy as np
import pytest

from pulsegrid.session import new_path
from pulsegrid.streaming import chunks as stream

RATE = 200
SCHEMA = "track_id string, epoch bigint, chunk_no bigint, samples array<double>"


def make(seed=0, n=9, size=70):
    rng = np.random.default_rng(seed)
    return {k: [rng.normal(size=size).tolist() for _ in range(n)] for k in ("a", "b")}


def expected(parts, rate=RATE):
    """Buffers of at least half a second, each keeping its last tenth for the next one."""
    every, start, size, out = np.concatenate([np.asarray(p, dtype=float) for p in parts]), 0, 0, []
    for p in parts:
        size += len(p)
        if size - start >= rate // 2:
            stop = size - rate // 10
            out += [b + start / rate for b in stream.buffer_beats(every[start:size], rate) if b < (stop - start) / rate]
            start = stop
    return [round(float(x), 9) for x in out]


def run(spark, batches):
    source, sink, state = (new_path(spark, p) for p in ("in", "out", "state"))
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(SCHEMA).parquet(source)
        job = (
            stream.detect_stream(live, rate=RATE).writeStream.format("parquet").option("checkpointLocation", state)
            .trigger(availableNow=True).start(sink)
        )
        job.awaitTermination()
    return spark.read.schema(stream.OUTPUT).parquet(sink).toPandas()


def beats(out, track, epoch=0):
    return sorted(round(x, 9) for x in out[(out.track_id == track) & (out.epoch == epoch) & (out.kind == "beat")].t)


def test_batches_resume_from_the_checkpoint(spark):
    data = make()
    rows = [[(k, 0, i, p) for k, parts in data.items() for i, p in enumerate(parts) if lo <= i < hi] for lo, hi in ((0, 4), (4, 9))]
    out = run(spark, rows)
    for k, parts in data.items():
        assert expected(parts) and beats(out, k) == sorted(expected(parts))


def test_late_and_repeated_chunks(spark):
    data = make(1)
    first = [("a", 0, i, data["a"][i]) for i in (1, 0, 3, 3)]
    second = [("a", 0, i, data["a"][i]) for i in (0, 2, 5, 4, 8, 7, 6)]
    assert beats(run(spark, [first, second]), "a") == sorted(expected(data["a"]))


def test_reset_and_data_in_one_batch(spark):
    data = make(2)["a"]
    rows = [("a", e, i, p) for e in (1, 0, 2) for i, p in enumerate(data)]
    out = run(spark, [rows[::-1], [("a", 1, 0, data[0])]])
    assert all(beats(out, "a", e) == sorted(expected(data)) for e in (0, 1, 2))


def feed(track, parts, first=0, epoch=0, most_held=64, detector=stream.buffer_beats):
    stream.apply_chunks(track, [(epoch, first + k, np.asarray(p, dtype=float)) for k, p in enumerate(parts)], detector, most_held)
    return stream.Track(track.rate, track.saved())  # as it comes back from the state store


def clicks(n, rate=RATE, every=0.5):
    x = np.random.default_rng(3).normal(size=n) * 0.01
    x[:: int(every * rate)] += 5.0
    return x


def test_a_track_goes_on_after_a_flush():
    x = clicks(4_000)
    parts = np.split(x, 40)
    track = stream.Track(RATE)
    stream.apply_chunks(track, [(0, k, p) for k, p in enumerate(parts[:20])], stream.buffer_beats, 64)
    before = len(track.rows)
    track.flush(stream.buffer_beats)
    again = stream.Track(RATE, track.saved())
    stream.apply_chunks(again, [(0, 20 + k, p) for k, p in enumerate(parts[20:])], stream.buffer_beats, 64)
    assert before >= 15 and len(again.rows) >= 15
    assert all(t >= 10.0 for _, _, t in again.rows) and again.seen == 4_000


def test_the_default_detector_finds_a_beat_in_the_rest():
    found = 0
    for shift in range(20):
        x = clicks(300)
        x[285 + shift % 10] += 8.0
        track = stream.Track(RATE)
        stream.apply_chunks(track, [(0, k, p) for k, p in enumerate(np.split(x, 3))], stream.buffer_beats, 64)
        out = len(track.rows)
        track.flush(stream.buffer_beats)
        found += len(track.rows) > out
        assert track.done == track.seen == 300
    assert found >= 5


def test_a_lost_chunk_is_reported_and_skipped():
    parts = np.split(clicks(4_000), 40)
    track = stream.Track(RATE)
    stream.apply_chunks(track, [(0, k, p) for k, p in enumerate(parts) if k != 3], stream.buffer_beats, 5)
    gaps = [t for _, kind, t in track.rows if kind == "gap"]
    assert gaps == [1.5] and not track.held and track.seen == 4_000
    assert max(t for _, kind, t in track.rows if kind == "beat") > 18
    waiting = stream.Track(RATE)
    stream.apply_chunks(waiting, [(0, k, p) for k, p in enumerate(parts[:8]) if k != 3], stream.buffer_beats, 5)
    assert len(waiting.held) == 4
    waiting.flush(stream.buffer_beats)
    assert not waiting.held and waiting.seen == 800


def test_flush_after_silence(spark):
    source, sink, state = (new_path(spark, p) for p in ("in", "out", "state"))
    spark.createDataFrame([("a", 0, 0, [0.0] * 150)], SCHEMA).write.mode("append").parquet(source)
    live = spark.readStream.schema(SCHEMA).parquet(source)
    found = stream.detect_stream(live, rate=RATE, detector=lambda v, r: np.array([0.05, len(v) / r - 0.05]), flush_after_ms=1)
    job = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start(sink)
    try:
        got = []
        for _ in range(60):  # a timeout needs a running trigger, so poll
            time.sleep(0.5)
            if spark.sparkContext._jvm.java.io.File(f"{sink}/_spark_metadata").exists():
                got = beats(spark.read.schema(stream.OUTPUT).parquet(sink).toPandas(), "a")
            if len(got) >= 2:
                break
    finally:
        job.stop()
    # the first buffer holds back its last 0.1 s; the silent track adds the beat at 0.7 s
    assert got == [0.05, 0.7]


@pytest.mark.parametrize("n", [10, 99, 100, 101])
def test_short_buffers_wait(n):
    track = stream.Track(RATE)
    stream.apply_chunks(track, [(0, 0, np.ones(n))], lambda v, r: np.array([0.0, len(v) / r - 0.01]), 64)
    assert (track.rows == []) == (n < 100)
    assert track.done == (0 if n < 100 else n - 20)


@pytest.mark.parametrize("rate", [200, 8_000, 44_100])
def test_any_rate(rate):
    track = stream.Track(rate)
    x = clicks(6 * rate, rate)
    stream.apply_chunks(track, [(0, k, p) for k, p in enumerate(np.split(x, 12))], stream.buffer_beats, 64)
    assert 8 <= len(track.rows) <= 13
