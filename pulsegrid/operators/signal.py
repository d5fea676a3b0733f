"""Sampled-signal operators on ``samples(track_id, idx, v)`` and on frame arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.sequence import CHUNK, TRACK, neighbours, over_chunks, with_stats

BUCKETS = 20_000  # fixed: target resolution of a waveform overview
HEADROOM = 0.99  # fixed: peak limit
FIR_TAPS = 31  # fixed: length of the anti-alias filter


# ---- channels -------------------------------------------------------------------------


def mono_to_stereo(samples: DataFrame) -> DataFrame:
    """B1: every sample on both channels, interleaved."""
    both = samples.withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("track_id", (F.col("idx") * 2 + F.col("ch")).alias("idx"), "v")


def stereo_to_mono(interleaved: DataFrame, *, odd: str = "truncate") -> DataFrame:
    """B2: (L+R)/2; a stray last value is dropped (``truncate``) or empties the track (``empty``)."""
    if odd == "empty":
        interleaved = with_stats(interleaved, TRACK, _n=F.count(F.lit(1))).filter(F.col("_n") % 2 == 0)
    pairs = interleaved.groupBy("track_id", F.expr("idx div 2").alias("idx")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return pairs.filter("n = 2").select("track_id", "idx", (F.col("s") * 0.5).alias("v"))


def downmix(interleaved: DataFrame, *, channels: int) -> DataFrame:
    """One channel is doubled, two pass through, more are averaged onto both sides."""
    if channels == 1:
        return mono_to_stereo(interleaved)
    if channels == 2:
        return interleaved
    frames = interleaved.groupBy("track_id", F.expr(f"idx div {channels}").alias("idx")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return mono_to_stereo(frames.filter(F.col("n") == channels).select("track_id", "idx", (F.col("s") / channels).alias("v")))


# ---- resampling and filters -------------------------------------------------------------


def resample_linear(
    samples: DataFrame, *, in_rate: int, out_rate: int, keys: Sequence[str] = TRACK, size: int = CHUNK, lengths: DataFrame | None = None
) -> DataFrame:
    """Linear interpolation at i/ratio for i < floor(n * ratio); the last value is held.

    Each input sample emits the few output positions that fall on it, so no task ever
    generates a whole track. ``lengths(keys, _n)`` may be passed when ``samples`` is costly.
    """
    if out_rate == in_rate:
        return samples.select(*keys, "idx", "v")
    ratio = out_rate / in_rate
    if lengths is None:
        lengths = samples.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    ahead = neighbours(samples, keys, "idx", lambda w: {"_next": F.lead("v").over(w)}, size=size)
    counted = ahead.join(lengths, list(keys))
    low = F.greatest(F.floor(F.col("idx") * F.lit(ratio)) - 1, F.lit(0))
    high = F.ceil((F.col("idx") + 1) * F.lit(ratio)) + 1
    out = counted.withColumn("_i", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    source = F.col("_i") / F.lit(ratio)
    out = out.filter((F.floor(source) == F.col("idx")) & (F.col("_i") < F.floor(F.col("_n") * F.lit(ratio))))
    frac = source - F.col("idx")
    value = F.when(F.col("_next").isNull(), F.col("v")).otherwise(F.col("v") * (1.0 - frac) + F.col("_next") * frac)
    return out.select(*keys, F.col("_i").alias("idx"), value.alias("v"))


def fir_taps(in_rate: int, out_rate: int) -> list[float]:
    """Blackman-windowed sinc of fixed length, normalised to unit gain."""
    half = FIR_TAPS // 2
    cutoff = min(0.999, out_rate / in_rate)
    raw = []
    for n in range(FIR_TAPS):
        k = n - half
        ideal = cutoff if k == 0 else math.sin(math.pi * cutoff * k) / (math.pi * k)
        window = 0.42 - 0.5 * math.cos(2 * math.pi * n / (FIR_TAPS - 1)) + 0.08 * math.cos(4 * math.pi * n / (FIR_TAPS - 1))
        raw.append(ideal * window)
    return [v / sum(raw) for v in raw]


def fir_filter(samples: DataFrame, taps: Sequence[float], *, keys: Sequence[str] = TRACK, size: int = CHUNK) -> DataFrame:
    """Centred convolution with zero padding, as one window expression per chunk."""
    half = len(taps) // 2

    def convolve(w: WindowSpec) -> dict[str, Column]:
        total = F.lit(0.0)
        for k, tap in enumerate(taps, start=-half):
            moved = F.col("v") if k == 0 else F.lag("v", -k).over(w) if k < 0 else F.lead("v", k).over(w)
            total = total + F.coalesce(moved, F.lit(0.0)) * F.lit(tap)
        return {"_y": total}

    return over_chunks(samples, keys, "idx", [convolve], before=half, after=half, size=size).select(*keys, "idx", F.col("_y").alias("v"))


def resample_antialias(samples: DataFrame, *, in_rate: int, out_rate: int, keys: Sequence[str] = TRACK, size: int = CHUNK) -> DataFrame:
    """Low-pass before B4, only when the rate goes down."""
    lengths = samples.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    if out_rate < in_rate:
        samples = fir_filter(samples, fir_taps(in_rate, out_rate), keys=keys, size=size)
    return resample_linear(samples, in_rate=in_rate, out_rate=out_rate, keys=keys, size=size, lengths=lengths)


def one_pole(samples: DataFrame, *, ratio: float, keys: Sequence[str] = TRACK, size: int = CHUNK) -> DataFrame:
    """y[i] = a x[i] + (1-a) y[i-1] with a = ratio/2; first and last sample unchanged.

    The geometric filter is built by doubling (1 + z)(1 + z^2)(1 + z^4)... with one ``lag``
    per step. Steps stop where (1-a)^k is below double precision, which bounds the border.
    """
    if ratio >= 1.0:
        return samples
    a = ratio * 0.5
    q = 1.0 - a
    span = 1
    while q**span > 2.0**-60:
        span *= 2
    size = max(size, span)  # a chunk holds the filter's whole memory
    counted = with_stats(samples, keys, _n=F.max("idx") + 1)
    driven = counted.withColumn("_y", F.when(F.col("idx") == 0, F.col("v")).otherwise(F.col("v") * F.lit(a)))

    def double(step: int):
        return lambda w: {"_y": F.col("_y") + F.lit(q**step) * F.coalesce(F.lag("_y", step).over(w), F.lit(0.0))}

    steps = [double(1 << k) for k in range(int(math.log2(span)))]
    out = over_chunks(driven, keys, "idx", steps, before=span, size=size)
    kept = (F.col("idx") == 0) | (F.col("idx") == F.col("_n") - 1)
    return out.select(*keys, "idx", F.when(kept, F.col("v")).otherwise(F.col("_y")).alias("v"))


# ---- framing ------------------------------------------------------------------------------


def frame_samples(samples: DataFrame, *, length: int, hop: int, rule: str = "full", keys: Sequence[str] = TRACK) -> DataFrame:
    """(track, frame_idx, pos, v). ``strict``: i+L < n; ``full``: i+L <= n; ``pad``: at least one frame."""
    first = F.greatest(F.ceil((F.col("idx") - (length - 1)) / F.lit(hop)), F.lit(0)).cast("long")
    spread = with_stats(samples, keys, _n=F.max("idx") + 1).withColumn(
        "frame_idx", F.explode(F.when(first <= F.expr(f"idx div {hop}"), F.sequence(first, F.expr(f"idx div {hop}"))))
    )
    end = F.col("frame_idx") * hop + length
    keep = {"strict": end < F.col("_n"), "full": end <= F.col("_n"), "pad": (end <= F.col("_n")) | (F.col("frame_idx") == 0)}[rule]
    return spread.filter(keep).select(*keys, "frame_idx", (F.col("idx") - F.col("frame_idx") * hop).alias("pos"), "v")


def hann(pos: Column, length: int) -> Column:
    """B8."""
    if length < 2:
        return F.lit(1.0)
    return F.lit(0.5) * (F.lit(1.0) - F.cos(F.lit(2.0 * math.pi) * pos / F.lit(length - 1)))


def hann_weights(length: int) -> np.ndarray:
    return np.ones(length) if length < 2 else 0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(length) / (length - 1)))


def next_pow2(n: Column) -> Column:
    """B9."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))).cast("long")


def zero_pad(x: Column) -> Column:
    """Pad an array with zeros to the next power of two."""
    return F.concat(x, F.array_repeat(F.lit(0.0), (next_pow2(F.size(x)) - F.size(x)).cast("int")))


def frame_energy(samples: DataFrame, *, length: int, hop: int, keys: Sequence[str] = TRACK) -> DataFrame:
    """B15 with the strict framing rule: a frame needs one more sample after its end.

    The check is a count inside the same aggregation, so map-side partial sums do the work
    and no per-track length has to be joined back.
    """
    first = F.greatest(F.ceil((F.col("idx") - length) / F.lit(hop)), F.lit(0)).cast("long")
    spread = samples.withColumn("frame_idx", F.explode(F.sequence(first, F.expr(f"idx div {hop}"))))
    inside = F.col("idx") - F.col("frame_idx") * hop < length
    agg = spread.groupBy(*keys, "frame_idx").agg(
        F.sum(F.when(inside, F.col("v") * F.col("v"))).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    return agg.filter(F.col("_n") == length + 1).select(*keys, "frame_idx", (F.col("_e") / F.lit(float(length))).alias("v"))


# ---- spectra ------------------------------------------------------------------------------


def _fft(rows: np.ndarray, kind: str, windowed: bool) -> np.ndarray:
    length = rows.shape[1]
    if windowed:
        rows = rows * hann_weights(length)
    padded = 1 << max(0, (length - 1).bit_length())
    spectrum = np.fft.rfft(rows, n=padded, axis=1)[:, : length // 2 + 1]
    power = spectrum.real**2 + spectrum.imag**2
    return power if kind == "power" else np.sqrt(power)


def spectrum(frames: DataFrame, *, kind: str = "magnitude", windowed: bool = True, x: str = "x", out: str = "mag") -> DataFrame:
    """B10 on frame arrays of equal length: one matrix FFT per Arrow batch, no shuffle."""
    schema = T.StructType([f for f in frames.schema.fields if f.name != x] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(batch.schema.get_field_index(x))
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            result = _fft(values.reshape(batch.num_rows, -1), kind, windowed)
            bins = result.shape[1]
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * bins, bins, dtype=np.int32))
            others = [n for n in batch.schema.names if n != x]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in others]
            yield pa.RecordBatch.from_arrays(arrays + [pa.ListArray.from_arrays(offsets, pa.array(result.ravel()))], names=others + [out])

    return frames.mapInArrow(run, schema)


def _per_block(
    samples: DataFrame, fields: list[T.StructField], fn: Callable[[np.ndarray, bool], dict], *, length: int, hop: int, kind: str,
    keys: Sequence[str], per_block: int, pad: bool, lead: int = 0,
) -> DataFrame:
    """B7, B8 and B10 in one pass: ``fn`` turns the spectra of a block of frames into columns, one value per own frame.

    Samples are shuffled once by (track, block of frames); a block holds ``per_block`` frames plus the overlap, whatever
    the track length, and ``lead`` frames of the block before. ``fn`` gets all of them and whether it is the first block,
    which has no lead. ``pad`` keeps one zero-padded frame for tracks shorter than a frame.
    """
    keys = list(keys)
    stride = per_block * hop
    reach = (per_block - 1) * hop + length
    low = F.greatest(F.ceil((F.col("idx") - (reach - 1)) / F.lit(stride)), F.lit(0)).cast("long")
    high = F.expr(f"(idx + {lead * hop}) div {stride}")
    blocks = samples.withColumn("_block", F.explode(F.when(low <= high, F.sequence(low, high))))
    schema = T.StructType([samples.schema[k] for k in keys] + [T.StructField("frame_idx", T.LongType())] + fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[-1])
        values = pdf.sort_values("idx")["v"].to_numpy(dtype=float)
        if pad and block == 0 and len(values) < length:
            values = np.concatenate([values, np.zeros(length - len(values))])
        borrowed = lead if block else 0
        if len(values) < length + borrowed * hop:
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in schema.names})
        rows = np.lib.stride_tricks.sliding_window_view(values, length)[::hop][: per_block + borrowed]
        made = fn(_fft(rows, kind, True), block == 0)
        out = pd.DataFrame({"frame_idx": block * per_block + np.arange(len(rows) - borrowed), **made})
        for name, value in reversed(list(zip(keys, key))):
            out.insert(0, name, value)
        return out

    return blocks.groupBy(*keys, "_block").applyInPandas(run, schema)


def stft(
    samples: DataFrame, *, length: int, hop: int, kind: str = "magnitude", keys: Sequence[str] = TRACK, per_block: int = 512, pad: bool = False
) -> DataFrame:
    """Spectra: (track, frame_idx, mag)."""
    fields = [T.StructField("mag", T.ArrayType(T.DoubleType()))]
    return _per_block(samples, fields, lambda mags, first: {"mag": list(mags)}, length=length, hop=hop, kind=kind, keys=keys, per_block=per_block, pad=pad)


def stft_flux(samples: DataFrame, *, length: int, hop: int, keys: Sequence[str] = TRACK, per_block: int = 512) -> DataFrame:
    """C3 on samples: (track, frame_idx, v). The spectra never leave the task that made them."""

    def flux(mags: np.ndarray, first: bool) -> dict:
        before = np.vstack([np.zeros(mags.shape[1]), mags[:-1]]) if first else mags[:-1]
        return {"v": np.maximum((mags if first else mags[1:]) - before, 0.0).sum(axis=1)}

    return _per_block(samples, [T.StructField("v", T.DoubleType())], flux, length=length, hop=hop, kind="magnitude", keys=keys, per_block=per_block, pad=False, lead=1)


def stft_mel(samples: DataFrame, bank: DataFrame, *, length: int, hop: int, keys: Sequence[str] = TRACK, per_block: int = 512) -> DataFrame:
    """B10 and B12 on samples: (track, frame_idx, mel array) of padded tracks, as one matrix product per block."""
    weights = bank_matrix(bank)
    fields = [T.StructField("mel", T.ArrayType(T.DoubleType()))]
    return _per_block(samples, fields, lambda power, first: {"mel": list(_log_mel(power, weights))}, length=length, hop=hop, kind="power", keys=keys, per_block=per_block, pad=True)


def bank_matrix(bank: DataFrame) -> np.ndarray:
    """The filterbank as a (bins, bands) array; its size is set by parameters."""
    rows = bank.toPandas()
    out = np.zeros((int(rows["bin"].max()) + 1, int(rows["mel"].max()) + 1))
    out[rows["bin"], rows["mel"]] = rows["weight"]
    return out


def _log_mel(power: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(power @ weights[: power.shape[1]], 1e-10))


def mel_filterbank(spark: SparkSession, *, rate: int, n_mels: int, n_fft: int, fmin: float, fmax: float) -> DataFrame:
    """(mel, bin, weight). Its size is fixed by ``n_mels`` and ``n_fft``."""

    def to_mel(hz: float) -> float:
        return 2595.0 * math.log10(1.0 + hz / 700.0)

    low, high = to_mel(fmin), to_mel(min(fmax, rate / 2.0))
    mel_step = (high - low) / (n_mels + 1)

    def edge(i: Column) -> Column:
        hz = F.lit(700.0) * (F.pow(F.lit(10.0), (F.lit(low) + i * F.lit(mel_step)) / F.lit(2595.0)) - 1.0)
        return F.floor(F.lit(float(n_fft + 1)) * hz / F.lit(float(rate))).cast("long")

    m = F.col("mel")
    bands = spark.range(n_mels).select(F.col("id").alias("mel")).select("mel", edge(m).alias("a"), edge(m + 1).alias("b"), edge(m + 2).alias("c"))
    bins = bands.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_fft // 2).cast("long"))))
    k = F.col("bin")
    raw = (
        F.when((k >= F.col("a")) & (k < F.col("b")), (k - F.col("a")) / (F.col("b") - F.col("a")))
        .when((k >= F.col("b")) & (k < F.col("c")), (F.col("c") - k) / (F.col("c") - F.col("b")))
        .otherwise(F.lit(0.0))
    )
    rows = with_stats(bins.withColumn("raw", raw.cast("double")), ["mel"], total=F.sum("raw"))
    weight = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("mel", "bin", weight.alias("weight"))


def mel_project(power: DataFrame, bank: DataFrame, *, n_mels: int, keys: Sequence[str] = TRACK, mag: str = "mag") -> DataFrame:
    """(track, frame_idx, mel, v) with v = ln(max(sum(power * weight), 1e-10)).

    One matrix product per Arrow batch, no shuffle. ``bank`` has at most n_mels * bins rows, set by parameters. Bands
    without any bin still give a row at the floor.
    """
    weights = bank_matrix(bank)
    kept = [*keys, "frame_idx"]
    schema = T.StructType([power.schema[k] for k in kept] + [T.StructField("mels", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(len(kept))
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * n_mels, n_mels, dtype=np.int32))
            mels = pa.ListArray.from_arrays(offsets, pa.array(_log_mel(values, weights).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], mels], names=[*kept, "mels"])

    projected = power.select(*kept, mag).mapInArrow(run, schema)
    return projected.select(*kept, F.posexplode("mels").alias("mel", "v")).withColumn("mel", F.col("mel").cast("long"))


# ---- bands and overviews --------------------------------------------------------------------


def band_edges(rate: float, n_fft: int) -> tuple[int, int, int, int]:
    """Bins of 20, 200 and 2000 Hz and the Nyquist bin."""
    width = rate / n_fft
    return int(20.0 / width), int(200.0 / width), int(2000.0 / width), n_fft // 2


def band_energy(spectra: DataFrame, *, rate: float, n_fft: int, mag: str = "mag") -> DataFrame:
    """Mean magnitude in bass, mid and high, by array slices of each row."""
    b0, b1, m1, top = band_edges(rate, n_fft)

    def mean(first: int, last: int, bins: int) -> Column:
        last = min(last, top - 1)
        if bins <= 0 or last < first:
            return F.lit(0.0)
        return F.aggregate(F.slice(mag, first + 1, last - first + 1), F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(bins))

    keep = [c for c in spectra.columns if c != mag]
    return spectra.select(
        *keep,
        mean(b0, b1, b1 - b0 + 1).alias("bass"),
        mean(b1 + 1, m1, m1 - b1).alias("mid"),
        mean(m1 + 1, top - 1, top - m1 - 1).alias("high"),
    )


def time_band_energy(samples: DataFrame, *, length: int, hop: int) -> DataFrame:
    """bass = mean |x|, high = mean |step| (first step of a frame from 0), mid = max(0, bass - high/2)."""
    stepped = neighbours(samples, TRACK, "idx", lambda w: {"_d": F.abs(F.col("v") - F.lag("v").over(w))})
    framed = frame_samples(stepped.withColumn("v", F.struct("v", "_d")), length=length, hop=hop, rule="full")
    step = F.when(F.col("pos") == 0, F.abs("v.v")).otherwise(F.col("v._d"))
    bands = framed.groupBy("track_id", "frame_idx").agg((F.sum(F.abs("v.v")) / length).alias("bass"), (F.sum(step) / length).alias("high"))
    return bands.withColumn("mid", F.greatest(F.lit(0.0), F.col("bass") - F.col("high") * 0.5))


def waveform_peaks(samples: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """Max |v| in buckets of max(1, n div buckets) samples."""
    sized = with_stats(samples, TRACK, _k=F.greatest(F.expr(f"(max(idx) + 1) div {buckets}"), F.lit(1)))
    return sized.groupBy("track_id", F.expr("idx div _k").alias("bucket")).agg(F.max(F.abs("v")).alias("peak"))


def band_peaks(bands: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """C4 on every band, then maxima in buckets of max(1, frames div buckets)."""
    names = ["bass", "mid", "high"]
    stats = {f"_{b}": F.max(b) for b in names}
    sized = with_stats(bands, TRACK, _k=F.greatest(F.expr(f"(max(frame_idx) + 1) div {buckets}"), F.lit(1)), **stats)
    maxima = sized.groupBy("track_id", F.expr("frame_idx div _k").alias("bucket")).agg(
        *[F.max(F.when(F.col(f"_{b}") > 0, F.col(b) / F.col(f"_{b}")).otherwise(F.col(b))).alias(f"{b}_raw") for b in names]
    )
    return maxima.select("track_id", "bucket", *[F.greatest(F.col(f"{b}_raw"), F.lit(0.0)).alias(b) for b in names])


def signal_stats(samples: DataFrame, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """B18."""
    return samples.groupBy(*keys).agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg(F.abs("v")).alias("mean_abs"))


def peak_limit(samples: DataFrame, *, keys: Sequence[str] = TRACK, limit: float = HEADROOM) -> DataFrame:
    """Scale a stem down to ``limit`` only if it exceeds it."""
    sized = with_stats(samples, keys, _m=F.max(F.abs("v")))
    return sized.withColumn("v", F.when(F.col("_m") > limit, F.col("v") * (F.lit(limit) / F.col("_m"))).otherwise(F.col("v"))).drop("_m")


def stem_mix(stems: DataFrame, *, first: str | int = "drums") -> DataFrame:
    """Sum of all stems over the length of the first one."""
    lengths = stems.filter(F.col("stem") == first).groupBy("track_id").agg((F.max("idx") + 1).alias("_n"))
    return stems.join(lengths, "track_id").filter(F.col("idx") < F.col("_n")).groupBy("track_id", "idx").agg(F.sum("v").alias("v"))


def bands_to_effects(bands: DataFrame) -> DataFrame:
    """Band energies capped at 1 drive zoom, saturation and brightness."""
    return bands.select(
        "track_id", "frame_idx",
        *[F.least(F.col(b), F.lit(1.0)).alias(n) for b, n in (("bass", "zoom"), ("mid", "saturation"), ("high", "brightness"))],
    )
