"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two or three shuffles of the edges with partial minima, so a star of any degree is
combined before it moves, and each round's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilake.session import store


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node (large: the larger ones; small: the smaller ones and itself) to their least."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every larger node has one edge, to a node that has none to a smaller one: each component is a star."""
    if edges.groupBy("a").count().where("count > 1").isEmpty():
        return edges.select(F.col("b").alias("c")).distinct().join(edges.select(F.col("a").alias("c")), "c", "left_semi").isEmpty()
    return False


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) bigint pairs. Returns (node, component): every node of an edge and the least node reachable.

    Empty edges give an empty table; loops, repeated and reversed edges are harmless.
    """
    current = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(current):
        current = store(_round(_round(current, True), False), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def merge(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) are added. Only the links between different components are gone through."""
    side = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    mapped = links.join(side, "a", "left").join(side.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    found = components(mapped.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return store(old.union(found.join(known.select("node"), "node", "left_anti")), "components")
