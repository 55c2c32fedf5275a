"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged, unstage


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u")
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """A node's larger neighbours point to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` links to ``node, component``: the smallest node that can be reached, for each node that has a link.

    Each round is written to the shared folder; the number of rounds follows the logarithm of the longest chain. Only two
    sums of each round reach the driver.
    """
    links = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sums = None
    while True:
        links, before = staged(_small_star(_large_star(links)), "links"), links
        unstage(before)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sums:
            break
        sums = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
