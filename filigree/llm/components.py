"""Connected components of an edge table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of each node on one side move to its least neighbour.

    The least is a pre-aggregated minimum that is joined back, so no neighbour list is ever
    gathered, whatever the degree.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = around.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        moved = edges.join(least, edges["low"] == least["node"]).select(F.col("high"), F.col("least").alias("low"))
        return moved.where("high > low").distinct()
    least = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    moved = edges.join(least, edges["high"] == least["node"])
    kept = moved.select(F.col("low").alias("high"), F.col("least").alias("low")).where("high > low")
    return kept.unionByName(least.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two lower neighbours, or a lower and a higher one."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below > 1 OR below = 1 AND above = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (low, high); a component is its least node.

    Rounds end when all that is left are stars; their number grows with the logarithm of
    the longest path. Each round is written to the shared folder.
    """
    now = written(edges.where("low < high").select("high", "low").distinct(), "edges")
    while not _are_stars(now):
        now = written(_star(_star(now, True), False), "edges")
    stars = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return stars.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
