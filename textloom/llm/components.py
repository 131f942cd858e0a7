"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import Workspace


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, move to the least of them."""
    least = _least_neighbour(edges)
    joined = edges.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """node, root of every node in ``links`` (a, b): the smallest node reachable.

    Null ends and self links are left out. The number of rounds grows with the
    logarithm of the longest chain; each round is written to the shared folder.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = ws.put(edges)
    state = None
    while True:
        # Every edge points from a node to a smaller one; done when all are stars.
        new = ws.put(_small_star(_large_star(edges)))
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(edges)
        edges = new
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    own = roots.select(F.col("root").alias("node"), "root").distinct()
    return roots.unionByName(own)
