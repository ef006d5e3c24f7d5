"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch


def _towards_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v): link every v of u to the least of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return edges.join(least, "u")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) to (node, root), root the least node of each component; only nodes with edges.

    A node with very many edges is split by the skew handling of the join; minima are
    combined on the map side.
    """
    stars = scratch.put(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}e"
    )
    step = 0
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.put(large, f"{name}l{step}")
        small = _towards_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        small = scratch.put(small.filter("u != v").distinct(), f"{name}s{step}")
        scratch.drop(f"{name}l{step}", f"{name}s{step - 1}" if step else f"{name}e")
        stars, step = small, step + 1
        parents = stars.select(F.col("v").alias("u")).distinct()
        chained = stars.join(parents, "u", "left_semi").limit(1)
        forked = stars.groupBy("u").count().filter("count > 1").select("u").limit(1)
        if chained.select("u").union(forked).isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                parents.select(F.col("u").alias("node"), F.col("u").alias("root"))
            )
