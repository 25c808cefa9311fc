"""Connected components of a graph given as rows, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, saved


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component): each node of an edge (a, b) with the least node that it is connected with.

    Each step pre-aggregates by node and joins back, so that a node with many neighbours is split over tasks; each
    step's rows are written to the shared folder, where the next one reads them. Steps stop when nothing changes.
    """
    spark = edges.sparkSession
    # a points to b < a
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # written, so that the join's sides are both dealt anew and a node with many neighbours can be split
        least = saved(least, folder, f"{name}-least-{k}")
        # every larger neighbour of a node goes to the node's least neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = saved(large, folder, f"{name}-large-{k}")
        # every smaller neighbour of a node, and the node, goes to its least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        old, now = f"{folder}/{name}-{k - 1}", saved(small, folder, f"{name}-{k}")
        removed(spark, f"{folder}/{name}-large-{k - 1}")
        removed(spark, f"{folder}/{name}-least-{k - 1}")
        removed(spark, old)
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
