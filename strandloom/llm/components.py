"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge: ``root`` is the least node of its component.

    Large-star and small-star steps: every node links its greater neighbours, then all its
    not greater ones, to the least node of its neighbourhood.  Neighbourhoods shrink into
    stars in a number of rounds that grows with the logarithm of the graph; no neighbour
    list is ever gathered, only minima, and each round is staged in the shared folder.
    """
    links = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x <> y").distinct()
    links = stage(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("v"), F.least("x", "low").alias("low"))
        # Large star: neighbours above v go to the least of v's neighbourhood.
        large = both.filter("y > x").join(least, F.col("x") == F.col("v")).select(F.col("y").alias("x"), F.col("low").alias("y")).distinct()
        large = stage(large, "large-star")
        # Small star: v and its neighbours below it go to the least of them.
        low = large.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("low"))
        joined = large.join(low, F.col("x") == F.col("v"))
        small = joined.select(F.col("y").alias("x"), F.col("low").alias("y")).filter("x <> y").unionByName(low.select(F.col("v").alias("x"), F.col("low").alias("y"))).distinct()
        small = stage(small, "small-star")
        # Done when every node has one parent and no parent has a parent.
        many = small.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        chain = small.join(small.select(F.col("x").alias("_p")).distinct(), F.col("y") == F.col("_p"), "left_semi").limit(1)
        if not many.unionAll(chain.select(F.col("x"), F.lit(0).cast("long").alias("n"))).take(1):
            return small.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(small.select(F.col("y").alias("node"), F.col("y").alias("root"))).distinct()
        links = small
