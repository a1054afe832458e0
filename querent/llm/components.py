"""Connected components of an edge table by alternating large-star and small-star steps, each a join and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent_if_small, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    # stored, so that a node with very many edges can be split where they meet its minimum
    least = sent_if_small(stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sent_if_small(stored(down.groupBy("u").agg(F.min("v").alias("m")), "least"))
    return down.join(least, "u").where("v <> m").select("v", "m").union(least.select("u", "m")).toDF("u", "v")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge to another."""
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        now = stored(_small_star(stored(_large_star(now), "stars")).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
