"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.session import durable


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of a link with the smallest node that it reaches.

    Large-star and small-star steps by turns, until links no longer change: every link is moved to the smallest
    neighbour of its end. Each step keeps one row per link and a minimum per node, so that a node with very
    many neighbours is no more work than they are. Loops and repeated links do no harm.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        edges = durable(_small_star(_large_star(edges)), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return (both.join(least, F.col("u") == F.col("_u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
    moved = edges.join(least, F.col("u") == F.col("_u"))
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct())
