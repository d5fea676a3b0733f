"""K1-K3: beat detection on a stream of sample chunks with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.carry import next_allowed
from pulsegrid.operators.score import MIN_INTERVAL, flux_scorer
from pulsegrid.operators.signal import hann_weights

MIN_BUFFER_S = 0.5  # fixed: shortest buffer worth detecting on
OVERLAP_S = 0.1  # fixed: left for the next buffer
WINDOW_S, HOP_S = 0.08, 0.02  # of the built-in detector
THRESHOLD = 0.3
END = np.array([np.nan])  # stands for a null chunk
MAX_HELD = 64  # chunks that may wait for a missing one before it counts as lost

OUTPUT = T.StructType([
    T.StructField("track_id", T.StringType()), T.StructField("epoch", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("t", T.DoubleType()),
])
STATE = T.StructType([
    T.StructField("epoch", T.LongType()),
    T.StructField("next_chunk", T.LongType()),
    T.StructField("seen", T.LongType()),
    T.StructField("done", T.LongType()),
    T.StructField("tail", T.ArrayType(T.DoubleType())),
    T.StructField("last_size", T.LongType()),
    T.StructField("held_no", T.ArrayType(T.LongType())),
    T.StructField("held", T.ArrayType(T.ArrayType(T.DoubleType()))),
])
Detector = Callable[[np.ndarray, int], np.ndarray]


def buffer_beats(values: np.ndarray, rate: int, *, threshold: float = THRESHOLD, gap: float = MIN_INTERVAL["beat"]) -> np.ndarray:
    """Beat times in one buffer: the built-in scorer on short spectra, scaled to 1, left-flat maxima, minimum gap."""
    window, hop = max(4, round(WINDOW_S * rate)), max(1, round(HOP_S * rate))
    if len(values) < window:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(values, window)[::hop] * hann_weights(window)
    spectra = np.abs(np.fft.rfft(frames, axis=1))
    flux = flux_scorer(np.vstack([np.zeros(spectra.shape[1]), spectra]))
    top = flux.max()
    flux = flux / top if top > 0 else flux
    middle = flux[1:-1]
    peak = (middle > threshold) & (middle >= flux[:-2]) & (middle > flux[2:])
    at = (np.flatnonzero(peak) + 1) * hop / rate
    later, kept, i = next_allowed(at, gap), [], 0
    while i < len(at):
        kept.append(i)
        i = int(later[i])
    return at[kept]


class Track:
    """Where one track stands: samples are counted from the start of its epoch, and all times follow from the counts.

    ``seen`` samples have come; beats before sample ``done`` are out. ``tail`` ends at ``seen`` and reaches back to
    ``done`` and at least half a second, so that the rest can be detected in context when the track falls silent.
    """

    def __init__(self, rate: int, saved: tuple | None = None):
        self.rate, self.least, self.overlap = rate, int(MIN_BUFFER_S * rate), int(OVERLAP_S * rate)
        self.rows: list[tuple[int, str, float]] = []
        self.start(0)
        if saved:
            self.epoch, self.next_chunk, self.seen, self.done, tail, self.last_size, numbers, arrays = saved
            self.tail = np.asarray(tail, dtype=float)
            self.held = {int(n): np.asarray(a, dtype=float) for n, a in zip(numbers, arrays)}

    def start(self, epoch: int) -> None:
        self.epoch, self.next_chunk, self.seen, self.done, self.last_size = epoch, 0, 0, 0, 0
        self.tail, self.held = np.zeros(0), {}

    def saved(self) -> tuple:
        return (
            int(self.epoch), int(self.next_chunk), int(self.seen), int(self.done), self.tail.tolist(), int(self.last_size),
            list(self.held), [a.tolist() for a in self.held.values()],
        )

    def report(self, times: np.ndarray, kind: str = "beat") -> None:
        self.rows += [(self.epoch, kind, float(t)) for t in times]

    def detect(self, first: int, upto: int, detector: Detector) -> None:
        """Report the beats in samples ``done`` to ``upto`` of a buffer that starts at sample ``first``."""
        found = np.asarray(detector(self.tail[first - self.seen :], self.rate), dtype=float)
        inside = (found >= (self.done - first) / self.rate) & (found < (upto - first) / self.rate)
        self.report(found[inside] + first / self.rate)
        self.done = upto

    def take(self, values: np.ndarray, detector: Detector) -> None:
        """K1 for the next chunk in line; K3 for the end mark."""
        if len(values) == 1 and np.isnan(values[0]):
            self.next_chunk += 1
            self.finish(detector)
            return
        self.tail = np.concatenate([self.tail, values])
        self.seen += len(values)
        self.next_chunk += 1
        self.last_size = len(values)
        if self.seen - self.done >= self.least:
            self.detect(self.done, self.seen - self.overlap, detector)
        wanted = max(self.seen - self.done, self.least)
        self.tail = self.tail[-wanted:] if wanted else self.tail[:0]

    def drain(self, detector: Detector, most_held: int) -> None:
        """Apply the chunks whose turn it is; when more than ``most_held`` wait, the missing ones count as lost."""
        while True:
            while self.next_chunk in self.held:
                self.take(self.held.pop(self.next_chunk), detector)
            if len(self.held) <= most_held:
                return
            self.skip()

    def skip(self) -> None:
        """Give up the chunks missing before the first one held; each is taken to be as long as the last one seen."""
        following = min(self.held)
        self.report(np.array([self.seen / self.rate]), "gap")
        self.seen += (following - self.next_chunk) * self.last_size
        self.done, self.next_chunk, self.tail = self.seen, following, np.zeros(0)

    def flush(self, detector: Detector) -> None:
        """K3: apply what waits, then report the beats of the samples left for a next buffer; the track can go on."""
        self.drain(detector, 0)
        self.finish(detector)

    def finish(self, detector: Detector) -> None:
        if self.seen > self.done:
            self.detect(self.seen - len(self.tail), self.seen, detector)


def apply_chunks(track: Track, chunks: list[tuple[int, int, np.ndarray]], detector: Detector, most_held: int) -> None:
    """Feed ``(epoch, chunk_no, samples)`` in that order; a later epoch starts the track over, an earlier one is past."""
    for epoch, number, values in sorted(chunks, key=lambda c: c[:2]):
        if epoch > track.epoch:
            track.drain(detector, most_held)
            track.start(epoch)
        if epoch == track.epoch and number >= track.next_chunk:
            track.held.setdefault(number, values)
            track.drain(detector, most_held)
    track.drain(detector, most_held)


def detect_stream(
    chunks: DataFrame, *, rate: int, detector: Detector = buffer_beats, flush_after_ms: int | None = None, most_held: int = MAX_HELD
) -> DataFrame:
    """K1: ``chunks(track_id, epoch, chunk_no, samples)`` to a stream of (track_id, epoch, kind, t).

    Chunks are applied by (epoch, chunk_no), whatever order they come in within a batch; early ones wait in the state
    and repeats are dropped. Where more than ``most_held`` wait for a missing chunk, it counts as lost: a row of kind
    ``gap`` tells where, and the track goes on behind it. K2: a higher epoch resets a track, its times start at 0.
    K3: a chunk with null ``samples`` marks the end of a track for now: the beats still held back come out, and the
    track may go on behind it. With ``flush_after_ms`` a track that stays silent that long is flushed as well.
    Timeouts need a running processing-time trigger; an available-now run would not end.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_after_ms else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = Track(rate, state.get if state.exists else None)
        if state.hasTimedOut:
            track.flush(detector)
        else:
            rows = [
                (int(e), int(n), END if v is None else np.asarray(v, dtype=float)) for batch in batches for e, n, v in zip(batch["epoch"], batch["chunk_no"], batch["samples"])
            ]
            apply_chunks(track, rows, detector, most_held)
            if flush_after_ms:
                state.setTimeoutDuration(flush_after_ms)
        state.update(track.saved())
        yield pd.DataFrame([(key[0], *r) for r in track.rows], columns=OUTPUT.names).astype({"epoch": "int64", "t": "float64"})

    return chunks.groupBy("track_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)
