"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").where("v <> m")
    return out.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    out = edges.join(least, "b")
    own = out.select(F.col("m").alias("a"), "b")
    others = out.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.union(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all nodes of ``edges`` (a < b) but the smallest of each component,
    which is the label.  The number of steps grows with the logarithm of a chain's length;
    tables stay in the cluster, and each step's table is written to the shared folder."""
    current = cut(edges.select("a", "b").distinct(), "links")
    while True:
        after = cut(_small_star(_large_star(current)), "links")
        # Done when every node has one edge, and no node with one has nodes tied to it.
        ends = after.select(F.col("b").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select(F.col("a").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            discard(current)
            return after.select(F.col("b").alias("id"), F.col("a").alias("label"))
        discard(current)
        current = after
