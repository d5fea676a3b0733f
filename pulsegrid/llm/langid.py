"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import forget, prepare, text_slices, unburdened

BITS = 15  # 2 ** BITS hashed n-gram features
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE = 400  # so many rows of each language fit the model
MAX_ROWS = 8_000  # and so many in all at most; with more than 20 languages each has its part
DRAWS = 10**15
SLICE = 1 << 20  # bytes of text whose n-grams are held at once
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the number of n-grams of each text, and its number of letters.

    Texts are lower-cased; everything that is no letter counts as one space. N-grams never span two texts.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letters = np.bincount(owner, letter, len(texts)).astype(np.int64)
    points = np.where(letter, points, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    points, owner = points[keep], owner[keep]
    mask = np.uint32((1 << BITS) - 1)
    codes, owners = [], []
    for n in ORDERS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        mixed = np.full(count, n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ points[k : k + count]) * FACTORS[k]
            mixed ^= mixed >> np.uint32(13)
        inside = owner[:count] == owner[n - 1 :]
        codes.append((mixed & mask)[inside])
        owners.append(owner[:count][inside])
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), letters
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return code[order], np.bincount(owner, minlength=len(texts)), letters


@dataclass
class LanguageModel:
    """Weights (features x languages, idf included), bias, languages, temperature."""

    weights: np.ndarray
    bias: np.ndarray
    languages: list[str]
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; ``und`` and 0 where it has no letter or nothing was learned."""
        code, counts, letters = features(texts)
        known = (letters > 0) & bool(self.languages)
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        filled = counts > 0
        starts = (np.cumsum(counts) - counts)[filled]
        for k in range(len(self.languages)):
            sums[filled, k] = np.add.reduceat(self.weights[:, k][code], starts, dtype=np.float64)
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share.max(axis=1), 0.0)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows never learned from: CRC-32 of the id as text divisible by ``parts``; null ids as well."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == 0, F.lit(True))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each feature stands, over all rows; the last entry is the number of documents."""
    width = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            for rows, texts in text_slices(batch, "text", SLICE):
                own = texts.to_pylist()
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    code, counts, _ = features(part)
                    seen = np.zeros((len(part), width), bool)
                    seen[np.repeat(np.arange(len(part)), counts), code] = True
                    total[:width] += seen.sum(axis=0)
                total[width] += rows.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(width + 1, np.int64)
    for r in docs.select("text").mapInArrow(unburdened(count), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


def sampled_rows(docs: DataFrame, rows_per_language: int, max_rows: int) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Language, features, shares and calibration flag of a bounded sample, equally many rows of each language that has so many.

    ``max_rows`` is divided among the languages before rows are drawn. They are drawn by a hash of id and text, so a run draws the same rows again.
    """
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    share = max(1, min(rows_per_language, max_rows // max(1, len(sizes))))
    wide = share + 6 * math.isqrt(share) + 6  # so many are drawn that chance hardly leaves fewer than the share
    drawn = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")), F.lit(DRAWS))
    rates = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(DRAWS * wide // n + 1))] or [F.lit(""), F.lit(0)])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = docs.where(drawn < rates[F.col("lang")]).select(drawn.alias("draw"), "doc_id", "lang", "text").withColumn("place", place).where(F.col("place") <= share)
    chosen = chosen.select("draw", "doc_id", "lang", "text")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text", SLICE):
                for k, text in enumerate(texts.to_pylist()):
                    code, _, letters = features([text])
                    if letters[0]:
                        at, n = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_pydict({"draw": rows.column(0).slice(k, 1), "lang": rows.column(2).slice(k, 1), "at": pa.array([at.astype(np.int32)]), "share": pa.array([(n / len(code)).astype(np.float32)])})

    found = chosen.mapInArrow(unburdened(shrink), "draw long, lang string, at array<int>, share array<float>").toPandas().sort_values(["draw", "lang"], kind="stable")
    return [(r.lang, np.asarray(r.at), np.asarray(r.share, np.float64), k % 5 == 0) for k, r in enumerate(found.itertuples())]


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_rows: int = MAX_ROWS, epochs: int = 4, alpha: float = 0.5, l1: float = 1e-4, l2: float = 1e-4, scale: float = 20.0) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang``; the caller leaves held-out rows away.

    Document frequencies cover all rows. The regression itself is fitted on at most ``max_rows`` rows drawn from them,
    by follow-the-regularised-leader with per-coordinate rates and an elastic-net penalty. A fifth of the sample is kept
    apart to set the temperature. Without a labelled row the model knows no language.
    """
    prepare(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL")
    sample = sampled_rows(labelled, rows_per_language, max_rows)
    languages = sorted({lang for lang, *_ in sample})
    width, kinds = 1 << BITS, len(languages)
    if not kinds:
        return LanguageModel(np.zeros((width, 0), np.float32), np.zeros(0), [], 1.0)
    counts = document_frequencies(labelled)
    idf = scale * (np.log((1.0 + counts[width]) / (1.0 + counts[:width])) + 1.0)
    z, n = np.zeros((width + 1, kinds)), np.zeros((width + 1, kinds))
    index = {lang: k for k, lang in enumerate(languages)}

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))

    rows = [(np.append(at, width), np.append(share * idf[at], 1.0), index[lang], kept) for lang, at, share, kept in sample]
    for _ in range(epochs):
        for at, x, target, kept in rows:
            if kept:
                continue
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[target] -= 1.0
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    logits = np.array([x @ w[at] for at, x, _, kept in rows if kept])
    truth = np.array([target for _, _, target, kept in rows if kept])
    return LanguageModel((idf[:, None] * w[:width]).astype(np.float32), w[width], languages, temperature_of(logits, truth))


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    if not len(truth):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def classify(docs: DataFrame, model: LanguageModel, out: str = "_language") -> DataFrame:
    """``docs`` with a struct column ``lang_pred``, ``score``, computed from ``text`` alone, over whole texts.

    Null and empty texts and texts without a letter give ``und`` with score 0. All columns and rows are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows features x languages only

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for series in texts:
            column = pa.array(series.where(series.notna(), ""), pa.string())
            names: list[str] = []
            scores: list[np.ndarray] = []
            for _, part in text_slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", SLICE):
                name, score = shared.value.predict(part.to_pylist())
                names += name
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    return docs.withColumn(out, predict(F.col("text")))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the rows that are not held out and predict all: ``doc_id, held_out, lang_pred, score``."""
    own = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(own.where("NOT held_out"), **options)
    return classify(own, model).select("doc_id", "held_out", "_language.lang_pred", "_language.score")
