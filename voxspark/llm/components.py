"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The minima are written, so that a hub's edges are one side of a plain join, which adaptive execution splits.
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    least = written(least, "least", narrow=True)
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge has a < b; b's smaller neighbours and b itself are sent to the least of them.
    least = written(edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), "least", narrow=True)
    sent = edges.join(least, F.col("b") == F.col("u"))
    return sent.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre, or a leaf of one centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))).alias("e")).select("e.*")
    by_node = ends.groupBy("node").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf"))
    return by_node.filter((F.col("leaf") + F.col("centre") > 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, part) of all nodes of edges (a, b): part is the least node reachable.

    Each step is a grouped minimum and a join on the node; edges are written between steps, until they are stars
    around the least nodes. The first table should be written: it is read twice. No edges give no rows; loops and repeated edges do no harm. Nothing is collected.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    while True:
        large = written(_large_star(now), "edges", narrow=True)
        now = written(_small_star(large), "edges", narrow=True)
        if _stars(now):
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("part")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("part")).distinct())
