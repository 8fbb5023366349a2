"""Orders resolved against calibration tables: the exact cell, else ever coarser medians of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import Part, many_medians
from tramo.params import DEFAULT, LIMITS, Params
from tramo.tables import stage


def _one(t: DataFrame) -> DataFrame:
    """The one row of t, or one without values."""
    return t.sparkSession.range(1).join(t, F.lit(True), "left").drop("id")


def fallback_lookup(facts: DataFrame, table: DataFrame, value: str, exact: Sequence[str], levels: Sequence[tuple[str, Sequence[str]]], out: str, source: str, n_out: str, exact_source, n: str | None = "n_cell", coarser: Sequence[DataFrame] | None = None) -> DataFrame:
    """facts with the table's value, where it came from, and the cell's n (0 on every fallback).

    exact: the table's keys, at most a row for each. levels: (source, keys) of unweighted medians of the table; the last
    has no keys. coarser: these medians, if they are known. Missing hours and weekdays count as -1; other missing keys match nothing.
    """
    keyed = facts
    names = {k: f"_k_{k}" for k in {*exact, *(k for _, ks in levels for k in ks)}}
    for k, name in names.items():
        keyed = keyed.withColumn(name, F.coalesce(F.col(k), F.lit(-1)) if k in ("pickup_hr_ksa", "dow") else F.col(k))
    hit = table.select(*[F.col(k).alias(names[k]) for k in exact], F.col(value).alias("_x"), exact_source.alias("_xs"), (F.col(n) if n else F.lit(0)).cast("long").alias("_xn"))
    keyed = keyed.join(hit, [names[k] for k in exact], "left")
    values, sources = [F.col("_x")], [F.when(F.col("_xs").isNotNull(), F.col("_xs"))]
    found = [F.col("_xs").isNotNull()]
    coarser = coarser or many_medians([Part(table, [ks for _, ks in levels], value)], stage)[0]
    for i, (label, keys) in enumerate(levels):
        t = coarser[i].select(*[F.col(k).alias(names[k]) for k in keys], F.col("v").alias(f"_m{i}"), F.lit(label).alias(f"_s{i}"))
        keyed = keyed.join(t, [names[k] for k in keys], "left") if keys else keyed.crossJoin(F.broadcast(_one(t)))
        values.append(F.col(f"_m{i}"))
        sources.append(F.col(f"_s{i}"))
        found.append(F.col(f"_s{i}").isNotNull())
    pick = F.coalesce(*[F.when(f, v) for f, v in zip(found, values, strict=True)])
    keyed = keyed.withColumns({out: pick, source: F.coalesce(*sources), n_out: F.coalesce("_xn", F.lit(0).cast("long"))})
    return keyed.drop(*names.values(), "_x", "_xs", "_xn", *[f"_{c}{i}" for c in "ms" for i in range(len(levels))])


def _cell_source(name: str):
    return F.when(F.col("n_cell") > 0, name).otherwise(F.concat(F.lit("parent:"), F.col("parent_level")))


RATIO_FALLBACKS = (("fallback:is_peak_dist", ("is_peak", "dist_bin")), ("fallback:hour", ("pickup_hr_ksa",)), ("fallback:global", ()))
BASELINE_FALLBACKS = (("fallback:hour", ("pickup_hr_ksa",)), ("fallback:is_peak", ("is_peak",)), ("fallback:global", ()))


def ratio_part(table: DataFrame) -> Part:
    return Part(table, [ks for _, ks in RATIO_FALLBACKS], "ratio_smoothed")


def baseline_part(table: DataFrame) -> Part:
    return Part(table, [ks for _, ks in BASELINE_FALLBACKS], "value_smoothed")


def ratio_lookup(facts: DataFrame, table: DataFrame, bin_col: str, out: str, source: str, n_out: str, coarser: Sequence[DataFrame] | None = None) -> DataFrame:
    """coarser: medians of ratio_part, if they are known."""
    new = {"is_peak": "_peak", "dist_bin": "_bin"}
    facts = facts.withColumn("_bin", F.col(bin_col)).withColumn("_peak", X.is_peak(F.col("pickup_hr_ksa")))
    levels = [(label, tuple(new.get(k, k) for k in ks)) for label, ks in RATIO_FALLBACKS]
    coarser = [t.withColumnsRenamed(new) for t in coarser] if coarser else None
    return fallback_lookup(facts, table.withColumnsRenamed(new), "ratio_smoothed", ("zone_name_en", "pickup_hr_ksa", "_bin"), levels, out, source, n_out, _cell_source("zone_hour_dist_smoothed"), coarser=coarser).drop("_bin", "_peak")


def baseline_lookup(facts: DataFrame, table: DataFrame, out: str, source: str, coarser: Sequence[DataFrame] | None = None) -> DataFrame:
    """coarser: medians of baseline_part, if they are known."""
    return fallback_lookup(facts, table, "value_smoothed", ("zone_name_en", "pickup_hr_ksa"), BASELINE_FALLBACKS, out, source, "_n", _cell_source("zone_hour_smoothed"), coarser=coarser).drop("_n")


def dwell_lookup(facts: DataFrame, table: DataFrame, hours: DataFrame, overall: DataFrame, out: str, source: str) -> DataFrame:
    x = facts.join(table.select("zone_name_en", "pickup_hr_ksa", F.col("dwell_smoothed").alias("_c")), ["zone_name_en", "pickup_hr_ksa"], "left")
    x = x.join(hours.select("pickup_hr_ksa", F.col("dwell_h").alias("_h")), "pickup_hr_ksa", "left").crossJoin(F.broadcast(overall))
    label = F.when(F.col("_c").isNotNull(), "zone_hour_dwell").when(F.col("_h").isNotNull(), "hour_dwell").otherwise("global_dwell")
    return x.withColumns({out: F.coalesce("_c", "_h", "dwell_g"), source: label}).drop("_c", "_h", "dwell_g")


def with_dwell(d: DataFrame, table: DataFrame, hours: DataFrame, overall: DataFrame) -> DataFrame:
    """The last leg: minutes at the door where the arrival is missing and the delivery isn't, else 0."""
    d = dwell_lookup(d, table, hours, overall, "_dwell", "dwell_source")
    needs = F.col("dropoff_arrived_ksa").isNull() & F.col("order_delivered_ksa").isNotNull()
    d = d.withColumns({"T4_dwell_P50": F.when(needs, X.clip(F.col("_dwell"), *LIMITS["T4"])).otherwise(0.0), "dwell_source": F.when(needs, F.col("dwell_source")).otherwise("none")})
    return d.drop("_dwell")


def value_lookup(facts: DataFrame, table: DataFrame, out: str, source: str, n_out: str) -> DataFrame:
    """The exact cell is the shop's first one by vertical; the coarser medians are of all rows."""
    keys = ["shop_id", "pickup_hr_ksa", "dow"]
    # names of the facts' columns, those of the exact cells apart from the table's
    exact = table.groupBy(*keys).agg(F.min_by(F.struct("value_smoothed", "n_cell"), F.coalesce("sub_vertical_name", F.lit("￿"))).alias("_f"))
    facts = facts.withColumns({"_h": F.coalesce("pickup_hr_ksa", F.lit(-1)), "_d": F.coalesce("dow", F.lit(-1))})
    x = facts.join(exact.select(F.col("shop_id"), F.col("pickup_hr_ksa").alias("_h"), F.col("dow").alias("_d"), "_f"), ["shop_id", "_h", "_d"], "left")
    sv, hd, g = many_medians([Part(table, (("sub_vertical_name", "pickup_hr_ksa", "dow"), ("pickup_hr_ksa", "dow"), ()), "value_smoothed")], stage)[0]
    sv = sv.select("sub_vertical_name", F.col("pickup_hr_ksa").alias("_h"), F.col("dow").alias("_d"), F.col("v").alias("_sv"))
    hd = hd.select(F.col("pickup_hr_ksa").alias("_h"), F.col("dow").alias("_d"), F.col("v").alias("_hd"))
    x = x.join(sv, ["sub_vertical_name", "_h", "_d"], "left").join(hd, ["_h", "_d"], "left").crossJoin(F.broadcast(_one(g.select(F.col("v").alias("_g")))))
    label = F.when(F.col("_f").isNotNull(), "shop_hour_dow").when(F.col("_sv").isNotNull(), "fallback:subvertical_hour_dow").when(F.col("_hd").isNotNull(), "fallback:hour_dow").otherwise("fallback:global")
    new = {out: F.coalesce("_f.value_smoothed", "_sv", "_hd", "_g"), source: label, n_out: F.coalesce("_f.n_cell", F.lit(0).cast("long"))}
    return x.withColumns(new).drop("_f", "_sv", "_hd", "_g", "_h", "_d")


def bias_lookup(facts: DataFrame, table: DataFrame, out: str, p: Params = DEFAULT) -> DataFrame:
    keys = ["zone_name_en", "pickup_hr_ksa", "stack_bkt"]
    x = facts.join(table.select(*keys, F.col("bias_smoothed").alias("_b"), F.col("n_cell").alias("_bn")), keys, "left")
    on = (F.col("_bn") >= p.bias_min_n) & (F.abs("_b") >= p.bias_min_abs)
    capped = F.greatest(F.lit(-p.bias_cap), F.least(F.lit(p.bias_cap), F.col("_b")))
    return x.withColumn(out, F.when(F.coalesce(on, F.lit(False)), capped).otherwise(0.0)).drop("_b", "_bn")
