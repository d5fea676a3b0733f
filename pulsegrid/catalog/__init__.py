"""Named queries over the shared test tables."""

from __future__ import annotations

import importlib

from pulsegrid.catalog import registry

MODULES = ["source_queries", "signal_queries", "envelope_queries", "tempo_queries", "lookup_queries", "segment_queries", "detector_queries"]


def load() -> tuple[dict[str, registry.Query], dict[str, str]]:
    for name in MODULES:
        importlib.import_module(f"pulsegrid.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
