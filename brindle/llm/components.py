"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't itself the smallest of its component.

    Each round is two aggregations and two joins on nodes; a hub's neighbours are never gathered in one row, and
    rounds grow with the logarithm of the components' diameter. Nulls and loops are left out.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = shared.cut(e)
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = shared.cut(small.union(below).distinct())
        if (now := _mark(e)) == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
