"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homeledger.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: the smallest node of its component.

    Nodes without an edge do not appear. Every round links all neighbours of a node to the
    smallest one, first the larger and then the smaller neighbours, and is stored in the shared
    folder; the rounds grow with the logarithm of a component's size. Minima are combined
    before the shuffle and joined back, so no task gathers a hot node's neighbours.
    """
    edges = edges.filter("a != b").select("a", "b")
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct(), f"{label}-components")
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b"), F.col("b")).distinct())
