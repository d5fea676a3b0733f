"""Packing: marks cut off ahead change no id, and equal rows fill all groups."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import packing, vocab


@pytest.mark.parametrize("extra", [[], ["́"]])
def test_marks_cut_ahead(extra):
    rng = random.Random(7)
    alphabet = ["Ab", "c", "9", " ", "\n", "\t", "\x0b", "\x0c", "\r", *vocab.CLOSING, "...", ").", "é", "ß", "İ", "Σ", "ﬁ", "漢", "½", "_", "'s", "\xa0", "\x1c", "[UNK]", "<|endoftext|>", *extra]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["", "a" * 3000 + "!" * 3000, "x." * 2000]
    encoder = vocab.word_encoder(public_tokenizers.path(packing.VOCABULARY))
    ids, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends, counts, strict=True):
        assert ids[end - count : end].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_memory_starting_afresh():
    texts = pa.array([f"word{k}, other{k}. {k}" for k in range(300)])
    path = public_tokenizers.path(packing.VOCABULARY)
    small = vocab.PartEncoder(vocab.word_encoder(path).tokenizer, vocab.parts_without_space, spaced=False, most=10)
    for at in range(0, 300, 7):
        want, got = (e.encode(texts.slice(at, 7)) for e in (vocab.word_encoder(path), small))
        assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_equal_rows_fill_all_groups(corpus_spark):
    rows = corpus_spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    groups = packing.dealt(rows.withColumn("_deal", F.monotonically_increasing_id())).groupBy("_salt").count().toPandas()
    assert len(groups) == 40_000 // packing.RANK_GROUP and groups["count"].max() < 3 * packing.RANK_GROUP
    packed = packing.pack(rows, 8).toPandas()
    assert len(packed) == 40_000 and not packed.duplicated(["sequence_id", "offset"]).any()
    assert packed.sequence_id.nunique() == 5_000 and set(packed.columns) == {*rows.columns, "sequence_id", "offset"}
