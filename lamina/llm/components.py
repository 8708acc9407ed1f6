"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, stored


def _least(edges: DataFrame) -> DataFrame:
    """a, m: the least of each node's neighbours and itself; aggregated before the shuffle, so that a hub is no burden."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger neighbours (large), or its smaller ones and itself, to the least node about it."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(_least(both), "least")
    rows = sized_join(both, least, ["a"])
    if large:
        return rows.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rows.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) of every node but the roots themselves, from edges a, b (nulls and loops are left out).

    Large and small stars in turn until nothing changes: a number of rounds that grows with the logarithm of the nodes. Each
    round's edges are a stored table."""
    tidy = lambda e: stored(e.where("a <> b").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = tidy(edges.select("a", "b"))
    was = None
    while (now := mark(edges)) != was:
        was = now
        if not now[0]:
            break
        edges = tidy(_star(tidy(_star(edges, True)), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
