"""Weighted medians, quantiles and recency weights that need no group in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cumulative weight counts as half of the total from this share below it, so that the order of summing can't matter.
SLACK = 1e-12


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """As a join by names, with NULL equal to NULL; no keys: right has one row."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]) if keys else None
    out = left.join(named, on, how) if keys else left.crossJoin(F.broadcast(named))
    return out.drop(*[f"_r_{k}" for k in keys])


#: Widths of the bins that a median is looked for in, one after another: the rows of the last one are of very few values.
WIDTHS = (1 / 16, 1 / (1 << 20))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, n: str, widths: Sequence[float] = WIDTHS, total: str | None = None) -> DataFrame:
    """By keys the lower weighted median (the first value at which half of all weight is reached), and the rows counted.

    Rows without value or weight are left out. Weights are summed by bins of the first width, then by narrower ones in the
    one bin where the half is reached, at last by value, always with partial sums: a key with most rows is no more than
    one of many. total: the name of a column with all weight.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")).where("_v is not null and _w is not null")
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    found = None
    for width in widths:
        at = F.floor(F.col("_v") / width)
        if found is None:
            bins = rows.groupBy(*keys, at.alias("_bin")).agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_n"))
            before, told = F.lit(0.0), {"_t": F.sum("_s").over(own), "_rows": F.sum("_n").over(own)}
        else:
            rows = join_keys(rows.withColumn("_bin", at_before), found, [*keys, "_bin"], "inner").select(*keys, "_v", "_w", "_before", "_t", "_rows")
            bins = rows.groupBy(*keys, at.alias("_bin")).agg(F.sum("_w").alias("_s"), *[F.first(c).alias(c) for c in ("_before", "_t", "_rows")])
            before, told = F.col("_before"), {}
            rows = rows.select(*keys, "_v", "_w")
        up = own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumns({"_c": F.sum("_s").over(up) + before, **told})
        reached = F.col("_c") >= F.col("_t") / 2 - F.col("_t") * SLACK
        # summed in another order, the half may lie a hair beyond the last bin: then it is the last one
        bins = bins.withColumn("_at", F.coalesce(F.min(F.when(reached, F.col("_bin"))).over(own), F.max("_bin").over(own))).where("_bin = _at")
        found, at_before = bins.select(*keys, "_bin", (F.col("_c") - F.col("_s")).alias("_before"), "_t", "_rows"), at
    inside = join_keys(rows.withColumn("_bin", at_before), found, [*keys, "_bin"], "inner")
    values = inside.groupBy(*keys, "_v").agg(F.sum("_w").alias("_s"), *[F.first(c).alias(c) for c in ("_before", "_t", "_rows")])
    up = own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.sum("_s").over(up) + F.col("_before") >= F.col("_t") / 2 - F.col("_t") * SLACK
    values = values.withColumn("_ok", reached)
    got = values.groupBy(*keys).agg(F.min(F.when(F.col("_ok"), F.col("_v"))).alias(out), F.max("_v").alias("_last"), F.first("_rows").alias(n), F.first("_t").alias("_t"))
    return got.select(*keys, F.coalesce(out, "_last").alias(out), n, *([F.col("_t").alias(total)] if total else []))


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], width: float = 1 / 16) -> DataFrame:
    """By keys the interpolated quantiles of columns; wanted: for each name the column and the share (0.5: the median).

    Nulls are left out; keys without any value have no row (without keys there is one row always). Rows are counted by
    bins of `width`, then by value in the one or two bins where the ranks lie, both with partial sums, as in
    weighted_median. NaN is the largest value.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])
    rows = df.select(*keys, F.explode(slots).alias("_x")).select(*keys, F.col("_x.slot").alias("_slot"), F.col("_x.v").alias("_v")).where("_v is not null")
    rows = rows.withColumn("_bin", F.when(F.isnan("_v"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("_v") / width)))
    # by name: its slot, and the ranks from 0 between which it lies
    at = {name: (F.col("_slot") == columns.index(c), (F.col("_t") - 1) * F.lit(float(q))) for name, (c, q) in wanted.items()}
    holds = lambda rank: (rank >= F.col("_c") - F.col("_n")) & (rank < F.col("_c"))
    own = Window.partitionBy(*keys, "_slot")
    up = own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(*keys, "_slot", "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_c": F.sum("_n").over(up), "_t": F.sum("_n").over(own)})
    bins = bins.where(reduce(lambda a, b: a | b, [slot & (holds(F.floor(x)) | holds(F.ceil(x))) for slot, x in at.values()]))
    bins = bins.select(*keys, "_slot", "_bin", (F.col("_c") - F.col("_n")).alias("_before"), "_t")
    # without keys there are two bins a name at most
    inside = join_keys(rows, bins if keys else F.broadcast(bins), [*keys, "_slot", "_bin"], "inner")
    values = inside.groupBy(*keys, "_slot", "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_t").alias("_t"))
    up = Window.partitionBy(*keys, "_slot", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_c", F.sum("_n").over(up) + F.col("_before"))
    ends = [F.max(F.when(slot & holds(end(x)), F.struct("_v", (x - F.floor(x)).alias("part")))).alias(f"_{k}_{side}") for k, (slot, x) in enumerate(at.values()) for side, end in (("low", F.floor), ("high", F.ceil))]
    got = values.groupBy(*keys).agg(*ends)
    out = []
    for k, name in enumerate(wanted):
        low, high, part = F.col(f"_{k}_low._v"), F.col(f"_{k}_high._v"), F.col(f"_{k}_low.part")
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return got.select(*keys, *out)


def with_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], *aggs: Column) -> DataFrame:
    """Aggregates of df by keys, and quantiles as quantiles gives them."""
    return join_keys(df.groupBy(*keys).agg(*aggs), quantiles(df, keys, wanted), keys)


@dataclass(frozen=True)
class Part:
    """Rows, the keys of each table of medians that is wanted of them, and their columns; no weight: interpolated medians."""

    rows: DataFrame
    keys: Sequence[Sequence[str]]
    value: str
    weight: str | None = None


def many_medians(parts: Sequence[Part], keep: Callable[[DataFrame, str], DataFrame]) -> list[list[DataFrame]]:
    """For each part a table for each of its keys: keys, v (the median), n (rows), and, if weighted, t (all weight).

    All tables are one: rows are exploded by table, with their keys as text, and go through the same passes. keep writes
    the result, which is as small as the tables. Either all parts have weights or none has.
    """
    wide = max(len(k) for p in parts for k in p.keys)
    names, rows, number = [f"_k{j}" for j in range(wide)], [], 0
    weighted = parts[0].weight is not None
    for p in parts:
        slots = []
        for keys in p.keys:
            slots.append(F.struct(F.lit(number).alias("_table"), *[(F.col(keys[j]) if j < len(keys) else F.lit(None)).cast("string").alias(x) for j, x in enumerate(names)]))
            number += 1
        x = p.rows.select(F.explode(F.array(*slots)).alias("_x"), F.col(p.value).cast("double").alias("_value"), (F.col(p.weight) if weighted else F.lit(None)).cast("double").alias("_weight"))
        rows.append(x.select("_x.*", "_value", "_weight"))
    every, by = reduce(DataFrame.unionByName, rows), ["_table", *names]
    found = weighted_median(every, by, "_value", "_weight", "v", "n", total="t") if weighted else with_quantiles(every, by, {"v": ("_value", 0.5)}, F.count(F.lit(1)).alias("n"))
    found, out, number = keep(found, "medians"), [], 0
    for p in parts:
        kinds, out = dict(p.rows.dtypes), [*out, []]
        for keys in p.keys:
            own = found.where(F.col("_table") == number)
            out[-1].append(own.select(*[F.col(names[j]).cast(kinds[k]).alias(k) for j, k in enumerate(keys)], "v", "n", *(["t"] if weighted else [])))
            number += 1
    return out


def recency_weight(ts: Column, ref: Column, half_life_days: float) -> Column:
    """1 at ref, half of it half_life_days before; NULL times weigh nothing, and all weigh 1 if there is no ref."""
    days = (F.unix_micros(ref) - F.unix_micros(ts)) / F.lit(86400e6)
    w = F.exp(F.lit(-math.log(2) / half_life_days) * F.greatest(days, F.lit(0.0)))
    return F.when(ref.isNull(), 1.0).when(ts.isNull(), 0.0).otherwise(w)


def with_recency(df: DataFrame, ts: Column, half_life_days: float, out: str = "w") -> DataFrame:
    """df with weights by the age of ts against the latest ts of df."""
    df = df.withColumn("_ts", ts)
    ref = df.agg(F.max("_ts").alias("_ref"))  # one row
    return df.crossJoin(F.broadcast(ref)).withColumn(out, recency_weight(F.col("_ts"), F.col("_ref"), half_life_days)).drop("_ts", "_ref")
