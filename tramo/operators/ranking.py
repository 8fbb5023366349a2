"""Row numbers and running sums over a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramo.tables import stage

#: Pieces that running sums are taken over; their totals are summed up in one task.
CHUNKS = 4096


def numbered(df: DataFrame, order: Sequence[str | Column], out: str = "at") -> DataFrame:
    """df with the numbers 0, 1, 2, ... in this order; rows that are equal in it are numbered in any order.

    Rows are dealt out by ranges, sorted within them, and written; a range's numbers go on from the sizes of those before
    it: a row for each partition.
    """
    local = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(out), 33)
    sizes = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col(out).bitwiseAND(F.lit((1 << 33) - 1))
    return local.join(F.broadcast(before), part == F.col("_part")).withColumn(out, inside + F.col("_before")).drop("_part", "_before")


def running_sums(df: DataFrame, at: str, rows: int, sums: Mapping[str, str]) -> DataFrame:
    """df, numbered from 0 to rows - 1 by at, with the sums of columns up to each row, itself included; sums: for each name the column."""
    d = df.withColumn("_chunk", F.expr(f"{at} div {max(1, -(-rows // CHUNKS))}"))
    own = Window.partitionBy("_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy("_chunk").agg(*[F.sum(c).alias(f"_s_{name}") for name, c in sums.items()])  # CHUNKS rows at most
    up = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_chunk", *[F.coalesce(F.sum(f"_s_{name}").over(up), F.lit(0)).alias(f"_b_{name}") for name in sums])
    d = d.withColumns({name: F.sum(c).over(own) for name, c in sums.items()}).join(F.broadcast(before), "_chunk")
    return d.withColumns({name: F.col(name) + F.col(f"_b_{name}") for name in sums}).drop("_chunk", *[f"_b_{name}" for name in sums])
