"""Beat detectors as one composition each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import envelope, grid, onset, score, signal, tempo
from pulsegrid.operators.carry import minimum_gap
from pulsegrid.operators.sequence import CHUNK, TRACK, dense_index, running_sum
from pulsegrid.session import stage

ENERGY_GAP_FRAMES = 18  # fixed: smallest distance of two energy beats, in frames


def number_beats(kept: DataFrame, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """Beat numbers from frame numbers. Kept peaks are few and costly, so they are written once."""
    return running_sum(stage(kept, "kept"), keys, "frame_idx", {"beat_idx": F.lit(1).cast("long")})


def energy_beats(
    samples: DataFrame, *, rate: int, sensitivity: float = 0.5, keys: Sequence[str] = TRACK, size: int = CHUNK, peak_chunk: int = 65_536
) -> DataFrame:
    """J1 up to the beats: frame energy, smoothing, threshold, strict maxima, minimum gap."""
    length = rate * 30 // 1000
    hop = length // 2
    energy = signal.frame_energy(samples, length=length, hop=hop, keys=keys)
    smooth = stage(envelope.smooth_and_mark(energy, keys=keys, size=size), "energy")
    limits = envelope.energy_threshold(smooth, sensitivity=sensitivity, keys=keys)
    loud = smooth.filter("is_peak").join(limits, list(keys)).filter(F.col("s") > F.col("threshold"))
    loud = loud.withColumn("at", F.col("frame_idx").cast("double"))
    kept = minimum_gap(
        loud, keys, "frame_idx", "at", float(ENERGY_GAP_FRAMES), reach=ENERGY_GAP_FRAMES, initial=0.0, size=peak_chunk
    )
    return number_beats(kept, keys=keys).select(
        *keys, "beat_idx", "frame_idx", (F.col("frame_idx") * hop / F.lit(float(rate))).alias("t")
    )


def frame_tempo(beats: DataFrame, *, seconds_per_frame: float, keys: Sequence[str] = TRACK) -> DataFrame:
    """D1, D2, D6 on frame numbers.

    Gaps are whole frames, so a track of n frames has at most sqrt(2n) distinct gaps and the
    median can be read from a small histogram.
    """
    gaps = tempo.intervals(beats, keys=keys, t="frame_idx")
    medians = tempo.upper_median(gaps, keys=keys, few_distinct=True)
    return medians.select(*keys, tempo.bpm_from_median(F.col("median") * F.lit(seconds_per_frame)).alias("raw_bpm"))


def hinted_beats(samples: DataFrame, *, rate: int, hint: Column, sensitivity: float = 0.5) -> DataFrame:
    """J1 with a tempo hint per track (E1): an even grid from the first beat found; without a hint the beats found.

    ``hint`` is an expression over ``track_id``; hints of 0 or less count as none, others are kept within 20-300. Tracks
    without a beat have no anchor and give no rows.
    """
    beats = stage(energy_beats(samples, rate=rate, sensitivity=sensitivity).select("track_id", "beat_idx", "t"), "beats")
    spans = samples.groupBy("track_id").agg(((F.max("idx") + 1) / F.lit(float(rate))).alias("duration"))
    firsts = beats.groupBy("track_id").agg(F.min("t").alias("first_beat"))
    anchors = spans.join(firsts, "track_id").withColumn("bpm", grid.clamp_hint(hint.cast("double")))
    plain = beats.join(anchors.filter("bpm = 0").select("track_id"), "track_id", "left_semi")
    return grid.even_grid(anchors).unionByName(plain)


def energy_tempo(samples: DataFrame, *, rate: int, sensitivity: float = 0.5, keys: Sequence[str] = TRACK) -> DataFrame:
    """Beats per track, median BPM and folded BPM; tracks without beats keep a row."""
    keys = list(keys)
    beats = stage(energy_beats(samples, rate=rate, sensitivity=sensitivity, keys=keys), "beats")
    hop = (rate * 30 // 1000) // 2
    counts = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_beats"))
    bpm = frame_tempo(beats, seconds_per_frame=hop / rate, keys=keys)
    base = samples.groupBy(*keys).agg(((F.max("idx") + 1) / F.lit(float(rate))).alias("duration"))
    joined = base.join(counts, keys, "left").join(bpm, keys, "left")
    raw = F.coalesce("raw_bpm", F.lit(0.0))
    return joined.select(
        *keys, "duration", F.coalesce("n_beats", F.lit(0)).cast("long").alias("n_beats"), raw.alias("raw_bpm"), tempo.octave_fold(raw).alias("bpm")
    )


def flux_envelope(samples: DataFrame, *, window: int, hop: int, sigma: float, keys: Sequence[str] = TRACK) -> DataFrame:
    """J2 up to the smoothed envelope: spectra, flux, z-score, Gaussian smoothing."""
    flux = signal.stft_flux(samples, length=window, hop=hop, keys=keys)
    scored = envelope.z_normalise(stage(flux, "flux"), keys=keys)
    return envelope.gaussian_smooth(scored, sigma=sigma, keys=keys)


def flux_beats(
    samples: DataFrame, *, rate: int, window: int = 2048, hop: int = 512, sigma: float = 2.0, factor: float = 1.5, min_gap: float = 0.25, keys: Sequence[str] = TRACK
) -> DataFrame:
    """Spectral-flux beats (no BPM)."""
    smooth = flux_envelope(samples, window=window, hop=hop, sigma=sigma, keys=keys)
    loud = envelope.peaks_over_local_threshold(smooth, factor=factor, keys=keys)
    timed = loud.withColumn("t", F.col("frame_idx") * hop / F.lit(float(rate)))
    kept = minimum_gap(timed, keys, "frame_idx", "t", min_gap, reach=int(min_gap * rate / hop) + 2)
    return number_beats(kept, keys=keys).select(*keys, "beat_idx", "frame_idx", "t")


def onset_beats(
    samples: DataFrame, *, in_rate: int, rate: int = 22_050, n_fft: int = 2048, hop: int = 512, min_beat_s: float = 0.25,
    fill: str = "frames", keys: Sequence[str] = TRACK,
) -> DataFrame:
    """J3 up to the beats: anti-alias resample, flux, IQR threshold, two peak passes.

    ``fill='frames'`` keeps the documented behaviour: gap filling compares frame distances
    with limits in seconds and so changes nothing. ``fill='seconds'`` fills gaps in seconds.
    """
    keys = list(keys)
    slow = signal.resample_antialias(samples, in_rate=in_rate, out_rate=rate, keys=keys)
    flux = stage(signal.stft_flux(slow, length=n_fft, hop=hop, keys=keys), "flux")
    env = stage(envelope.local_maximum(envelope.max_normalise(flux, keys=keys), keys=keys, rule="flat_right"), "onset")
    limits = stage(envelope.iqr_threshold(env, keys=keys), "limits")
    loud = env.filter("is_peak").join(limits, keys).filter(F.col("v") > F.col("threshold"))
    gap = int(min_beat_s * rate / hop)
    first = stage(
        minimum_gap(loud.withColumn("at", F.col("frame_idx").cast("double")), keys, "frame_idx", "at", float(gap), reach=gap), "peaks"
    )
    peaks = onset.rescue_gaps(env, first, limits, min_gap=gap, keys=keys)
    beats = number_beats(peaks, keys=keys).select(*keys, "beat_idx", "frame_idx", (F.col("frame_idx") / F.lit(rate / hop)).alias("t"))
    if fill == "frames":
        return beats
    durations = samples.groupBy(*keys).agg(((F.max("idx") + 1) / F.lit(float(in_rate))).alias("duration"))
    filled = grid.fill_gaps(beats, durations, keys=keys)
    return dense_index(filled.select(*keys, "t"), keys, ["t"], "beat_idx").select(*keys, "beat_idx", F.lit(None).cast("long").alias("frame_idx"), "t")


def onset_tempo(beats: DataFrame, *, keys: Sequence[str] = TRACK) -> DataFrame:
    """J3 tail: D3-D5, D7 and D9 for each track with beats."""
    keys = list(keys)
    rows = stage(tempo.intervals(beats, keys=keys), "intervals")
    best = tempo.dominant_interval(rows, low=0.2, high=2.0, bins_per_second=200, for_gaps=False, keys=keys)
    picked = tempo.tempo_candidates(rows, best, keys=keys)
    sure = tempo.regularity(rows, keys=keys)
    counts = beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_beats"))
    bpm = F.when((F.col("n_beats") >= 4) & (F.col("candidate") > 0), tempo.octave_fold(F.lit(60.0) / F.col("candidate"))).otherwise(0.0)
    return counts.join(picked, keys, "left").join(sure, keys, "left").select(
        *keys, "n_beats", F.coalesce(bpm, F.lit(0.0)).alias("bpm"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def log_mel(
    samples: DataFrame, *, in_rate: int, rate: int = 22_050, n_mels: int = 81, n_fft: int = 2048, hop: int = 441,
    fmin: float = 30.0, fmax: float = 11_000.0, keys: Sequence[str] = TRACK,
) -> DataFrame:
    """J4 front end: resample, power spectra, mel projection; (keys, frame_idx, mel array)."""
    keys = list(keys)
    if in_rate != rate:
        samples = signal.resample_linear(samples, in_rate=in_rate, out_rate=rate, keys=keys)
    bank = signal.mel_filterbank(samples.sparkSession, rate=rate, n_mels=n_mels, n_fft=n_fft, fmin=fmin, fmax=fmax)
    return signal.stft_mel(samples, bank, length=n_fft, hop=hop, keys=keys)


def model_beats(
    samples: DataFrame, *, in_rate: int, scorer: score.Scorer | None = None, threshold: float | None = None, rate: int = 22_050,
    hop: int = 441, keys: Sequence[str] = TRACK, **mel,
) -> DataFrame:
    """Mel spectra, any scorer, activation peaks. The built-in scorer has no scale of its own and is normalised per
    track; what another scorer returns is compared with the threshold as it is."""
    spectra = log_mel(samples, in_rate=in_rate, rate=rate, hop=hop, keys=keys, **mel)
    scored = stage(score.score_frames(spectra, scorer, keys=keys), "scores")
    activation = envelope.max_normalise(scored, keys=keys) if scorer is None else scored
    peaks = score.activation_peaks(activation, "beat", frame_rate=rate / hop, threshold=threshold, keys=keys)
    return peaks.withColumnRenamed("seg_idx", "beat_idx")


def model_analysis(
    samples: DataFrame, *, in_rate: int, scorer: score.HeadScorer | None = None, thresholds: dict[str, float] | None = None, rate: int = 22_050,
    hop: int = 441, **mel,
) -> dict[str, DataFrame]:
    """J4 with all heads: ``beats``, ``downbeats`` and labelled ``segments`` from one scoring of the track."""
    spectra = log_mel(samples, in_rate=in_rate, rate=rate, hop=hop, **mel)
    scored = stage(score.score_heads(spectra, scorer), "scores")
    levels, frames = {**score.THRESHOLDS, **(thresholds or {})}, rate / hop

    def head(name: str) -> DataFrame:
        return scored.select("track_id", "frame_idx", F.col(name).alias("v"))

    durations = samples.groupBy("track_id").agg(((F.max("idx") + 1) / F.lit(float(in_rate))).alias("duration"))
    classes = scored.select("track_id", "frame_idx", F.col("classes").alias("x"))
    found = {f"{h}s": score.activation_peaks(head(h), h, frame_rate=frames, threshold=levels[h]).withColumnRenamed("seg_idx", "beat_idx") for h in ("beat", "downbeat")}
    return {**found, "segments": score.labelled_segments(head("segment"), classes, durations, frame_rate=frames, threshold=levels["segment"])}


def stem_detector(samples: DataFrame, *, length: int, detector: Callable[[DataFrame], DataFrame], per_stem: bool = False) -> DataFrame:
    """Separate, then detect on the drums, or on every stem with ``stem`` as one more key."""
    stems = score.separate(samples, length=length)
    if not per_stem:
        chosen = grid.stem_fallback(stems, samples)
        return detector(chosen.select("track_id", "idx", "v"))
    return detector(stems)


def stereo_stem_detector(interleaved: DataFrame, *, in_rate: int, model_rate: int, length: int, detector: Callable[[DataFrame], DataFrame], per_stem: bool = False) -> DataFrame:
    """J5 and I4 on two interleaved channels: separate at the model's rate, make every stem mono, then detect."""
    stems = stage(score.stem_mono(score.separate_stereo(interleaved, in_rate=in_rate, model_rate=model_rate, length=length)), "mono-stems")
    if per_stem:
        return detector(stems)
    mix = score.channels_at(interleaved, in_rate=in_rate, model_rate=model_rate).groupBy("track_id", "idx").agg(F.avg("v").alias("v"))
    return detector(grid.stem_fallback(stems, mix).select("track_id", "idx", "v"))
