"""Chances that op1's hashing loses a link."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.llm import embed_dedup


@pytest.mark.parametrize("vectors", [1_000, 1_000_000, 75_000_000])
def test_links_at_the_threshold_share_a_bucket(vectors):
    bits, tables = embed_dedup.table_sizes(vectors, embed_dedup.THRESHOLD)
    same = (1.0 - np.arccos(embed_dedup.THRESHOLD) / np.pi) ** bits
    assert (1.0 - same) ** tables <= 1e-4
