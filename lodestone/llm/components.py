"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the least of them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (node, root): root is the least node reachable; nodes without an edge are absent.

    A centre with a third of all edges is no hot key: the least of a centre is summed up in each task and written, so that
    both sides of its join come from a shuffle of their own, and Spark may split the large one. Each round is cut, so a lost executor costs a round at most. Rounds end when the edges don't change; their number
    grows with the logarithm of the longest path.
    """
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(now)
    while was[0]:
        now = cut(_small(_large(now)))
        if (found := state(now)) == was:
            break
        was = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
