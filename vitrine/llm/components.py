"""Connected components of links between records, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import scratch


def _to_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours on the smallest neighbour: the larger ones of each node, or (small star) the smaller ones and itself."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    hung = pairs.join(least, "a")
    if both_ways:
        hung = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` in any direction, repeats and loops allowed -> ``(node, component)``, component the smallest node.

    Nodes without a link to another are not listed. Each step is an aggregate and an equi-join, so a node with any number of links
    is combined per task and split by the join; the number of steps grows with the logarithm of the longest path.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = scratch.settled(links.filter("a <> b").select(larger, smaller).distinct())
    before = None
    while True:
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(row)
        large = _to_smallest(edges, both_ways=True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = scratch.settled(_to_smallest(large, both_ways=False))
