"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import stage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component_id`` for every id in ``links`` (``a``, ``b``); the component is its smallest id.

    Each round hangs the larger neighbours of every node on its smallest neighbour, then does the same for the smaller
    ones. The number of rounds follows the logarithm of the longest path. Rounds are written to the shared folder, so
    the plan stays short and a lost executor costs one round at most. Repeated links, links of an id to itself and links
    with a null end count for nothing.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(both, F.col("v") > F.col("u"))
        edges = stage(_star(edges, F.lit(True)).distinct(), "links")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hung = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return stage(hung.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()), "components")


def _star(pairs: DataFrame, moved) -> DataFrame:
    """Hang the moved neighbours ``v`` of each ``u`` on the smallest of ``u`` and its neighbours; ``u`` too if it moves.

    The minima are written before they are joined: both sides are then plain scans, whose hot keys Spark can split.
    """
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("v_min")).select("u", F.least("u", "v_min").alias("m")), "minima")
    found = pairs.where(moved).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return found.where("u <> v").unionByName(own)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v") % 1_000_003)).first())
