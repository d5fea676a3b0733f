"""Small tables with every odd case."""

from __future__ import annotations

import random

import pytest

from pulsegrid.session import ship

CLASHING = "fp long, rep long, core long, order long, mark long, length long, place long, ids string, host string, bucket string, candidate string, label string, vec string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def corpus_spark(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def make_docs(corpus_spark):
    """A documents table from (doc_id, text, lang) rows, with columns named like the operators' own."""

    def make(rows):
        width = CLASHING.count(",") + 1
        filler = [None if "string" not in c else "x" for c in CLASHING.split(",")]
        full = [(i, t, lang, None, None, *filler[:width]) for i, t, lang in rows]
        return corpus_spark.createDataFrame(full, DOCS)

    return make


def words(rng: random.Random, count: int) -> str:
    syllables = "ta re no mi lu ke so da vi po ga zu fe hi jo".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts that are null, empty, blank, tiny, repeated, very long, and rows with null and repeated ids."""
    rng = random.Random(4)
    shared = words(rng, 120)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "a", "en"), (5, "é😀 ß\u0301", "de"), (6, shared, "en"), (7, shared, "en"),
        (8, words(rng, 30) + " " + shared + " " + words(rng, 40), "en"), (9, words(rng, 60) + "\n" + shared[10:500], "en"), (10, "ab" * 900, "en"),
        (11, "z" * 1300, None), (12, words(rng, 20_000), "fr"), (None, words(rng, 50), "en"), (None, None, None), (6, shared, "en"), (13, words(rng, 3), "en"),
    ]
    return rows + [(20 + k, words(rng, rng.randint(1, 200)), rng.choice(["en", "fr"])) for k in range(40)]
