"""Connected components by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import written


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours are linked with the least of them and the node itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if not larger_only else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    linked = seen.join(least, "a")
    if not larger_only:
        linked = linked.filter("b > a")
    rows = linked.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if larger_only:
        rows = rows.unionByName(least.select("a", F.col("low").alias("b")))
    return rows.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node that each node of an edge reaches.

    Ends when all components are stars around their least node, which is looked up
    in the edges alone; each round's edges are a written table. A node's edges are
    summed to their least before the join that brings it back.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(ordered.distinct(), "edges")
    while True:
        now = written(_stars(_stars(now, False), True), "edges")
        # Edges lead to lesser nodes: stars have one edge per node, and none from a centre.
        several = now.groupBy("a").agg(F.count("*").alias("edges")).filter("edges > 1").select("a")
        chained = now.join(now.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if several.unionByName(chained).isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
