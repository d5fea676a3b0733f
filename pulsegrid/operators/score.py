"""Scoring of frames by a pluggable model, and what follows from its activations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import envelope, segments, signal
from pulsegrid.operators.carry import minimum_gap
from pulsegrid.operators.lookup import segment_labels
from pulsegrid.operators.sequence import CHUNK, TRACK, running_sum, with_stats
from pulsegrid.session import stage

Scorer = Callable[[np.ndarray], np.ndarray]
HeadScorer = Callable[[np.ndarray], dict[str, np.ndarray]]
HEADS = ["beat", "downbeat", "segment"]

THRESHOLDS = {"beat": 0.7, "downbeat": 0.7, "segment": 0.5}  # fixed: default activation thresholds
MIN_INTERVAL = {"beat": 0.27, "downbeat": 0.54, "segment": 1.0}  # fixed: seconds
PRESETS = {"BeatNet": (81, 441), "TCN": (81, 441), "AllInOne": (128, 220)}  # fixed: mel bands, hop
PART_ROWS = 2_000_000  # rows of a part in which the ends of segments meet, about
STEMS = ["drums", "bass", "other", "vocals"]  # fixed: stem order


def flux_scorer(rows: np.ndarray) -> np.ndarray:
    """Default scorer: rectified rise against the previous frame, summed over bands.

    The first row is the frame before the block (or zeros) and gets no score.
    """
    return np.maximum(np.diff(rows, axis=0), 0.0).sum(axis=1)


def flux_heads(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Default scorer with all heads: rise for beats, rise of the lower half for downbeats, change for segments, bands as classes."""
    change = np.diff(rows, axis=0)
    rise = np.maximum(change, 0.0)
    return {"beat": rise.sum(axis=1), "downbeat": rise[:, : rows.shape[1] // 2].sum(axis=1), "segment": np.abs(change).sum(axis=1), "classes": rows[1:]}


def _score_blocks(
    mel: DataFrame, fields: list[T.StructField], fn: Callable[[np.ndarray], dict], *, keys: Sequence[str], x: str, per_block: int, context: int
) -> DataFrame:
    """Columns that ``fn`` makes of blocks of frames, each with ``context`` frames before it (zeros at the track start)."""
    keys = list(keys)
    home = F.expr(f"frame_idx div {per_block}")
    spill = F.when(F.col("frame_idx") % per_block >= per_block - context, home + 1)
    blocks = mel.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(F.array(home, spill))))
    schema = T.StructType([mel.schema[k] for k in keys] + [T.StructField("frame_idx", T.LongType())] + fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        rows = np.stack(pdf[x].to_numpy()).astype(float)
        borrowed = int((pdf["_home"] < pdf["_block"]).sum())
        if borrowed == len(rows):
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in schema.names})
        rows = np.concatenate([np.zeros((context - borrowed, rows.shape[1])), rows])
        made = {name: list(v) if v.ndim > 1 else v for name, v in fn(rows).items()}
        out = pd.DataFrame({"frame_idx": pdf["frame_idx"].to_numpy()[borrowed:], **made})
        for name, value in reversed(list(zip(keys, key))):
            out.insert(0, name, value)
        return out

    return blocks.groupBy(*keys, "_block").applyInPandas(run, schema)


def score_frames(
    mel: DataFrame, scorer: Scorer | None = None, *, keys: Sequence[str] = TRACK, x: str = "mel", per_block: int = 2048, context: int = 1
) -> DataFrame:
    """I1, one head: (keys, frame_idx, v) from a scorer applied to blocks of frames.

    A block carries ``context`` frames before it (zeros at the track start), so any scorer
    with a bounded look-back gives the same result for every block size. The scorer gets
    (context + frames) rows and returns one activation per frame after the context.
    """
    scorer = scorer or flux_scorer
    return _score_blocks(mel, [T.StructField("v", T.DoubleType())], lambda rows: {"v": scorer(rows)}, keys=keys, x=x, per_block=per_block, context=context)


def score_heads(
    mel: DataFrame, scorer: HeadScorer | None = None, *, keys: Sequence[str] = TRACK, x: str = "mel", per_block: int = 2048, context: int = 1
) -> DataFrame:
    """I1, all heads: (keys, frame_idx, beat, downbeat, segment, classes).

    The scorer returns a dictionary of these names: one activation per frame for the first three, one row of class
    scores per frame for ``classes``. What it returns is passed on as it is. The built-in scorer has no scale of its
    own, so its activations are divided by their maximum in the track.
    """
    fields = [T.StructField(h, T.DoubleType()) for h in HEADS] + [T.StructField("classes", T.ArrayType(T.DoubleType()))]
    raw = _score_blocks(mel, fields, scorer or flux_heads, keys=keys, x=x, per_block=per_block, context=context)
    if scorer is not None:
        return raw
    scaled = with_stats(stage(raw, "heads"), list(keys), **{f"_{h}": F.max(h) for h in HEADS})
    return scaled.withColumns({h: F.when(F.col(f"_{h}") > 0, F.col(h) / F.col(f"_{h}")).otherwise(F.col(h)) for h in HEADS}).drop(*[f"_{h}" for h in HEADS])


def activation_peaks(
    activation: DataFrame, kind: str, *, frame_rate: float, threshold: float | None = None, keys: Sequence[str] = TRACK, value: str = "v"
) -> DataFrame:
    """Peaks (left-flat rule) above the threshold, at least the kind's interval apart; (keys, seg_idx, frame_idx, t)."""
    level = THRESHOLDS[kind] if threshold is None else threshold
    marked = envelope.local_maximum(activation, keys=keys, value=value, rule="flat_left")
    loud = marked.filter(F.col("is_peak") & (F.col(value) > level)).withColumn("t", F.col("frame_idx") / F.lit(frame_rate))
    reach = int(MIN_INTERVAL[kind] * frame_rate) + 2
    kept = minimum_gap(loud, keys, "frame_idx", "t", MIN_INTERVAL[kind], reach=reach)
    return running_sum(stage(kept, "kept"), keys, "frame_idx", {"seg_idx": F.lit(1).cast("long")}).select(*keys, "seg_idx", "frame_idx", "t")


def labelled_segments(
    activation: DataFrame, class_scores: DataFrame, durations: DataFrame, *, frame_rate: float, threshold: float | None = None
) -> DataFrame:
    """I2 segments: boundaries (H12) with labels."""
    peaks = activation_peaks(activation, "segment", frame_rate=frame_rate, threshold=threshold)
    spans = segments.segments_from_peaks(peaks, durations)
    lengths = activation.groupBy("track_id").agg((F.max("frame_idx") + 1).alias("n_frames"))
    return segment_labels(spans, class_scores, lengths, rate=frame_rate)


def band_split(rows: np.ndarray) -> np.ndarray:
    """Default separator: four spectral bands of each segment; (segments, 4, length)."""
    spectra = np.fft.rfft(rows, axis=1)
    edges = np.linspace(0, spectra.shape[1], len(STEMS) + 1).astype(int)
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        part = np.zeros_like(spectra)
        part[:, low:high] = spectra[:, low:high]
        out.append(np.fft.irfft(part, n=rows.shape[1], axis=1))
    return np.stack(out, axis=1)


def separate(samples: DataFrame, separator: Callable[[np.ndarray], np.ndarray] | None = None, *, length: int, limit: bool = True) -> DataFrame:
    """Overlapping segments (H16) -> separator -> overlap-add (H17) -> peak limit.

    Each (track, segment) is one group of ``length`` samples. The last segment is padded for
    the separator and cut back to its real length.
    """
    separator = separator or band_split
    cut = segments.overlap_segments(samples, length=length)
    schema = T.StructType([
        samples.schema["track_id"], T.StructField("stem", T.StringType()), T.StructField("seg", T.LongType()),
        T.StructField("pos", T.LongType()), T.StructField("v", T.DoubleType()),
    ])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("pos")["v"].to_numpy(dtype=float)
        padded = np.zeros((1, length))
        padded[0, : len(values)] = values
        stems = separator(padded)[0]
        return pd.concat([
            pd.DataFrame({"track_id": key[0], "stem": name, "seg": key[1], "pos": np.arange(len(values)), "v": stems[i][: len(values)]})
            for i, name in enumerate(STEMS)
        ])

    # written once: the overlap-add and the limit read it several times, and the separator may be costly
    parts = stage(cut.groupBy("track_id", "seg").applyInPandas(run, schema), "stems")
    keyed = parts.withColumn("track_id", F.struct("track_id", "stem")).drop("stem")
    merged = segments.overlap_add(keyed, length=length).select(F.col("track_id.track_id").alias("track_id"), F.col("track_id.stem").alias("stem"), "idx", "v")
    joined = stage(merged, "separated")
    return signal.peak_limit(joined, keys=["track_id", "stem"]) if limit else joined


def stereo_split(rows: np.ndarray) -> np.ndarray:
    """``band_split`` of each channel: (segments, 2, length) to (segments, 4, 2, length)."""
    return np.stack([band_split(rows[:, c]) for c in range(rows.shape[1])], axis=2)


def channels_at(interleaved: DataFrame, *, in_rate: int, model_rate: int) -> DataFrame:
    """(track_id, ch, idx, v) of two interleaved channels at the model's rate.

    Each channel is resampled on its own (B4), behind the one-pole filter (B6) where the rate goes down. A last value
    without its partner is dropped.
    """
    whole = with_stats(interleaved, TRACK, _n=F.expr("(max(idx) + 1) div 2"))
    parted = whole.select("track_id", (F.col("idx") % 2).cast("int").alias("ch"), F.expr("idx div 2").alias("idx"), "v", "_n").filter("idx < _n").drop("_n")
    keys = ["track_id", "ch"]
    if model_rate < in_rate:
        parted = stage(signal.one_pole(parted, ratio=model_rate / in_rate, keys=keys), "filtered")
    return signal.resample_linear(parted, in_rate=in_rate, out_rate=model_rate, keys=keys)


def separate_stereo(
    interleaved: DataFrame, separator: Callable[[np.ndarray], np.ndarray] | None = None, *, in_rate: int, model_rate: int, length: int, limit: bool = True
) -> DataFrame:
    """I3 on stereo: (track_id, stem, ch, idx, v) at ``model_rate``.

    Both channels of a segment reach the separator together, as (1, 2, length), so it may use what they share; it returns
    (1, stems, 2, length). Stems are overlap-added per channel and limited by the louder of their channels. A group holds
    two channels of one segment.
    """
    separator = separator or stereo_split
    resampled = channels_at(interleaved, in_rate=in_rate, model_rate=model_rate)
    keyed = resampled.select(F.struct("track_id", "ch").alias("track_id"), "idx", "v")
    cut = segments.overlap_segments(keyed, length=length).select("track_id.track_id", "track_id.ch", "seg", "pos", "v")
    fields = [T.StructField("stem", T.StringType()), T.StructField("ch", T.IntegerType()), T.StructField("seg", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("size", T.LongType())]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        padded = np.zeros((1, 2, length))
        padded[0, pdf["ch"].to_numpy(), pdf["pos"].to_numpy()] = pdf["v"].to_numpy(dtype=float)
        count = int(pdf["pos"].max()) + 1
        stems = separator(padded)[0]
        return pd.concat([
            pd.DataFrame({"track_id": key[0], "stem": name, "ch": np.int32(c), "seg": key[1], "pos": np.arange(count), "v": stems[i, c, :count], "size": count})
            for i, name in enumerate(STEMS) for c in range(2)
        ])

    parts = stage(cut.groupBy("track_id", "seg").applyInPandas(run, T.StructType([interleaved.schema["track_id"], *fields])), "stems")
    packed = parts.withColumn("track_id", F.struct("track_id", "stem", "ch")).drop("stem", "ch")
    merged = stage(segments.overlap_add(packed, length=length, size="size", partitions=parts_for(parts)).select("track_id.*", "idx", "v"), "separated")
    return signal.peak_limit(merged, keys=["track_id", "stem"]) if limit else merged


def parts_for(written: DataFrame) -> int:
    """Partitions of at most about ``PART_ROWS`` rows for a relation that is written and so cheap to count."""
    return max(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // PART_ROWS))


def stem_mono(stems: DataFrame) -> DataFrame:
    """B2 per stem: (track_id, stem, idx, v), the mean of both channels. Both meet in parts of about ``PART_ROWS`` rows."""
    dealt = stems.withColumn("_home", F.expr(f"idx div {CHUNK}")).repartition(parts_for(stems), "track_id", "stem", "_home")
    return dealt.groupBy("track_id", "stem", "_home", "idx").agg(F.avg("v").alias("v")).drop("_home")


def model_type(outputs: Column, declared: Column) -> Column:
    """A custom model with an output named like a segment head is AllInOne, otherwise BeatNet."""
    guess = F.when(F.exists(outputs, lambda x: x.contains("segment")), "AllInOne").otherwise("BeatNet")
    return F.when(declared == "Custom", guess).otherwise(declared)
