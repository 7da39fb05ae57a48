"""Connected components of an edge table: alternating large-star and small-star steps, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs → ``(node, component)`` for every node in an edge; component: its smallest node.

    A large-star step hangs all larger neighbours of a node on the smallest of its neighbourhood, a small-star
    step the smaller ones; when nothing changes, every node hangs on its component's smallest. Minima are
    aggregated before the shuffle, so a node with very many edges is no hot group there; the joins that
    follow are plain joins, which adaptive execution splits. Each round is cut into the shared folder.
    """
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """pairs: (u, v), every neighbour v of u that the step looks at, as rows."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        hung = pairs.join(least, "u").where(F.col("v") > F.col("u") if larger else F.lit(True))
        new = hung.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger:
            new = new.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        now = cut(star(both, larger=True))
        now = cut(star(now.select(F.col("a").alias("u"), F.col("b").alias("v")), larger=False))
        # a fixed point of both steps has the same edges; sums of hashes tell without keeping the last round
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == mark:
            break
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return hung.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
