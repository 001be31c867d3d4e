"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of node and neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Edges that join a node to itself or hold a null are left out.  Every round
    is written once, so its lineage is short; a node's neighbours are never
    gathered in one place.
    """
    now = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        tied = _large_star(now).where("u <> v").distinct()
        now = stage(_small_star(tied).where("u <> v").distinct(), "edges")
        # Done when every node hangs on one node, and that one on none.
        ups = now.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("up"), F.lit(0).cast("bigint").alias("down"))
        downs = now.groupBy(F.col("v").alias("n")).agg(F.lit(0).cast("bigint").alias("up"), F.count("*").alias("down"))
        held = ups.union(downs).groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if held.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
