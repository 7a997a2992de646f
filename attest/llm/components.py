"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialised



def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours."""
    ways = both_ways(edges)
    least = ways.groupBy("a").agg(F.min("b").alias("least"))
    return ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these; ``a`` is the larger end."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a")
    return tied.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    Large and small stars in turn, each a partial aggregation and a join, until the links are stars. Null ends and
    links of a node with itself are ignored. Rounds grow with the logarithm of the number of nodes."""
    edges = materialised(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = mark
        edges = materialised(small_star(large_star(edges)), "links")
