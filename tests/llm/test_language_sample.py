"""How the rows of a language sample are shared out."""

from __future__ import annotations

import random
from collections import Counter

from pulsegrid.llm import langid
from tests.llm.conftest import words


def test_the_row_limit_is_shared_among_languages(make_docs):
    rng = random.Random(9)
    sizes = {f"l{k:02d}": 600 if k < 25 else 12 for k in range(30)}
    rows = [(1000 * n + k, words(rng, 5), lang) for n, (lang, size) in enumerate(sizes.items()) for k in range(size)]
    got = Counter(lang for lang, *_ in langid.sampled_rows(make_docs(rows), 40, 600))
    assert got == {lang: min(size, 20) for lang, size in sizes.items()}


def test_one_repeated_id_keeps_the_sample_bounded(make_docs):
    rng = random.Random(10)
    rows = [(7, words(rng, 5), "aa") for _ in range(500)] + [(1000 + k, words(rng, 5), "bb") for k in range(500)]
    got = Counter(lang for lang, *_ in langid.sampled_rows(make_docs(rows), 30, 60))
    assert got == {"aa": 30, "bb": 30}
