"""The earliest share of rows, without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramo.operators.ranking import numbered

LAST = (1 << 63) - 1


def temporal_split(df: DataFrame, ts: str, tiebreak: str, share: float, out: str = "is_train", bin_s: int = 3600) -> DataFrame:
    """df with whether a row is among the first floor(share * n) by ts, then tiebreak; rows without ts come last.

    Rows are counted by bins of time; only those of the bin where the share ends are numbered in order, in ranges, to find
    the first row beyond it. All rows are then compared with that one; rows of its time and tiebreak are beyond it too.
    """
    at = F.unix_micros(ts)
    keyed = df.select(at.alias("_at"), F.coalesce(F.floor(at / (bin_s * 1_000_000)), F.lit(LAST)).alias("_bin"), F.col(tiebreak).alias("_tie"))
    up = Window.orderBy("_bin")  # a row for each bin
    bins = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.withColumns({"_c": F.sum("_n").over(up), "_all": F.sum("_n").over(Window.partitionBy(F.lit(0)))}).withColumn("_k", F.floor(F.col("_all") * F.lit(share)))
    edge = bins.where("_c > _k and _c - _n <= _k").select("_bin", (F.col("_k") - (F.col("_c") - F.col("_n"))).alias("_room")).first()
    if edge is None:  # all rows are in the share
        return df.withColumn(out, F.lit(True))
    inside = numbered(keyed.where(F.col("_bin") == edge["_bin"]).select("_at", "_tie"), [F.col("_at").asc_nulls_last(), "_tie"], "_number")
    first = inside.where(F.col("_number") == edge["_room"]).first()
    before = F.col(tiebreak) < F.lit(first["_tie"])
    if first["_at"] is None:
        return df.withColumn(out, F.coalesce(at.isNotNull() | before, F.lit(False)))
    return df.withColumn(out, F.coalesce((at < F.lit(first["_at"])) | ((at == F.lit(first["_at"])) & before), F.lit(False)))
