"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def _to_least(edges: DataFrame) -> DataFrame:
    """u, v, m with m the least of u and its neighbours v; mins are combined before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v): root is the component's least node.

    Each round is a few shuffles of the edges, written to shared storage; a star's edges number its leaves, so
    no group of neighbours is ever gathered into one value. Rounds grow with the logarithm of the diameter.
    """
    edges = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        near = _to_least(large)
        small = near.select("u", F.col("m").alias("v")).unionByName(near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialise(small.distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
