"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.sources.settle import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    out = down.join(least, down["a"] == least["u"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of edges (a, b) but the least of its component, and that least node. Longs, no nulls.

    Each pass writes the edges to the shared folder. Passes end when the edges form stars; there are about log2 of the
    longest path of them. Links and components stay in Spark. No edges: no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        edges = settle(_small_star(_large_star(edges)), "links")
        below = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")  # hangs from a node that hangs itself; a star's root counts once, or one task would sort all its links
        torn = edges.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("n")).where("n > 1").select("b")  # hangs from two
        if below.unionByName(torn).isEmpty():
            return edges
