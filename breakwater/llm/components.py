"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_join(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(down, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """edges: u, v (any order, loops and repeats allowed, no nulls). Returns u, v: every node that has a smaller one in its
    component, with the component's smallest node. Nodes that are smallest or alone don't appear. Edges stay distributed; the driver
    sees two numbers a round. Each round is a table in the shared folder, so a lost executor costs no more than the round."""
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    seen = None
    for _ in range(max_rounds):
        after = stored(_small_star(_large_star(now)), label)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = after
        if tuple(state) == seen:
            return now
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
