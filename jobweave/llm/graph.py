"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("least", "node"))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    tied = edges.join(least, "high").select("high", "low", "least")
    return tied.select(F.explode(F.array("high", "low")).alias("high"), F.col("least").alias("low")).where("high != low").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of longs).

    The component is its smallest node. Loops, repeated edges and either
    direction are fine; null ends are ignored; no edges give no rows. A node's
    neighbours are never gathered: minima are pre-aggregated and hub joins are
    ordinary equi-joins, which skew splitting can cut. Each round ends in a
    table of the shared folder, so a lost executor costs one round at most.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = stage(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high != low and low is not null").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)")).alias("s")).first()
        if found.n == 0 or (found.n, found.s) == mark:
            break
        mark = (found.n, found.s)
        now = stage(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
