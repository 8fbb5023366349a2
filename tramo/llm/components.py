"""Connected components by alternating large and small stars; links stay distributed and every round is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.llm.staging import drop_staged, stage


def _large(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest one it knows."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. a > b in every row."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b (longs, either way round, repeated or looped). node, component (the least node reachable) of every node that has a link."""
    e = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, last = now, e
        e = stage(_small(_large(e).where("a <> b").distinct()).where("a <> b").distinct(), "links")
        drop_staged(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
