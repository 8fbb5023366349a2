"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A frequent-items sketch (Misra-Gries counters, merged from all partitions) names the digests that may be frequent. Their
winners are then counted exactly and broadcast: their rows are settled where they are read. All other digests, none of
which is frequent, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramo.llm.staging import BROADCAST_ROWS, lower_ascii, small, stage, unused

#: Counters of the sketch, which bound the digests that are broadcast and what reaches the driver. A digest with more than
#: 3.5 / COUNTERS of all rows always has one; those with an estimate over 1 / COUNTERS of them are settled apart.
COUNTERS = 4096


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The largest id of a group stays; a null
    id stays only if its group has no other. Rows that repeat the id that stays are all kept, since ids name rows.
    Columns of docs other than the two are not read. An empty table gives an empty result.
    """
    rows = stage(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(lower_ascii(F.col(text_col)), 256)).alias("digest")), "digests")
    rows = rows.withColumn("short", F.xxhash64("digest"))
    seen = rows.agg(F.expr(f"approx_top_k(short, {counters}, {counters})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    heavy = [x["item"] for x in seen["top"] or [] if x["count"] > max(1, seen["n"] / counters)]
    winners = rows.where(F.col("short").isin(heavy)).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # short hashes of at most `counters` digests, so that many groups, but for collisions: a bounded side
    winners = F.broadcast(stage(winners.where("group_size > 1"), "winners"))
    light = Window.partitionBy("digest")
    settled = rows.join(winners, "digest").select("id", "digest", "keep_id", "group_size")
    rest = rows.join(winners, "digest", "left_anti").select("id", "digest", F.max("id").over(light).alias("keep_id"), F.count(F.lit(1)).over(light).alias("group_size"))
    out = settled.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows with a null id are dropped if their group has another.

    A row is dropped for its own text: other texts of its id, or other rows without an id, are not.
    """
    gone = decide(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest"))
    return without(docs, stage(gone.distinct(), "dropped"), id_col, sha256(lower_ascii(F.col(text_col))))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def without(docs: DataFrame, gone: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """The rows of docs whose id (null equal to null) and digest aren't in gone: id and digest, staged."""
    gone_id, gone_digest = unused(docs, "gone_id"), unused(docs, "gone_digest")
    gone = gone.select(F.col("id").alias(gone_id), F.col("digest").alias(gone_digest))
    # a row is a few times as wide as an id
    on = F.col(id_col).eqNullSafe(F.col(gone_id)) & (digest == F.col(gone_digest))
    return docs.join(small(gone, BROADCAST_ROWS // 4), on, "left_anti")
