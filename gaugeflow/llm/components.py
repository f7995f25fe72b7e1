"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is its component's least node.

    Each round points the neighbours of a node at the least of them, first the larger ones and
    then the smaller ones, which about squares the reach of a node. Every round is a written table, so
    lineage stays short. A node with many neighbours is only ever a key of a partial minimum
    and of a join, never one task's group.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = (large.join(least, F.col("u") == F.col("k")).filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
                 .distinct())
        edges = written(small, "links")
        before, mark = mark, _mark(edges)
        if before == mark:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"),
                                                  F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free hash of the links, to see whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
