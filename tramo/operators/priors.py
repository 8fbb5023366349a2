"""Preparation times as priors of the waiting leg, and the blend of cell, parent and prior."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import Part, join_keys, many_medians, with_recency
from tramo.params import DEFAULT, Params
from tramo.tables import stage

ALIASES = {"mbo_chain_id": "shop_id", "sub_vertical_detail": "sub_vertical_name"}


def _prep_minutes(d: DataFrame) -> DataFrame:
    if "prep_time_min" in d.columns:
        return d
    if "prep_time_sec" in d.columns:
        return d.withColumn("prep_time_min", X.to_number(F.col("prep_time_sec")) / 60)
    return d.withColumn("prep_time_min", X.minutes_between(F.col("picked_up_at"), F.col("accepted_at")) if {"picked_up_at", "accepted_at"} <= {*d.columns} else F.lit(None).cast("double"))


def from_orders(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    d = _prep_minutes(X.rename_aliases(df, ALIASES))
    ts = X.first_of(d, ["picked_up_at"] if "picked_up_at" in d.columns else ["accepted_at"])
    at = F.col("accepted_at")
    return d.select("shop_id", "sub_vertical_name", X.hour_in(at, p.hour_zone).alias("pickup_hr_ksa"), X.weekday_in(at, p.hour_zone).alias("dow"), "prep_time_min", ts.alias("ts")).dropna(subset=["prep_time_min"])


def from_groups(df: DataFrame, key: str) -> DataFrame:
    """Rows by shop or vertical; -1 stands for any hour or weekday."""
    d = _prep_minutes(X.rename_aliases(df, ALIASES))
    d = X.with_default(X.with_default(d, "pickup_hr_ksa", -1), "dow", -1)
    return d.select(key, "pickup_hr_ksa", "dow", "prep_time_min", X.first_of(d, ["picked_up_at"] if "picked_up_at" in d.columns else ["accepted_at"]).alias("ts"))


def build(tables: Sequence[tuple[DataFrame, Sequence[str]]], half_life: float, keep: Callable[[DataFrame, str], DataFrame] = stage) -> list[DataFrame]:
    """tables: rows and their keys. For each its recency-weighted medians by keys, hour and weekday, all from the same passes."""
    # several passes read them
    parts = [Part(keep(with_recency(rows, F.col("ts"), half_life), "prep"), [[*keys, "pickup_hr_ksa", "dow"]], "prep_time_min", "w") for rows, keys in tables]
    return [one.withColumnsRenamed({"v": "prior_p50", "n": "n_prior"}).drop("t") for (one,) in many_medians(parts, keep)] if parts else []


def _merge(base: DataFrame, prior: DataFrame, keys: Sequence[str], relax: str) -> DataFrame:
    """base with prior_p50 and n_prior where it has none yet: the exact row, any hour, any weekday, (relax 'both') any of both.

    A key's rows, one for each hour and weekday, are a list that is joined once.
    """
    lists = prior.groupBy(*keys).agg(F.collect_list(F.struct("pickup_hr_ksa", "dow", "prior_p50", "n_prior")).alias("_p"))
    hour, day, any_ = F.col("pickup_hr_ksa"), F.col("dow"), F.lit(-1)

    def step(p: Column) -> Column:
        same_hour, same_day, any_hour, any_day = (p["pickup_hr_ksa"].eqNullSafe(x) if k % 2 == 0 else p["dow"].eqNullSafe(x) for k, x in enumerate((hour, day, any_, any_)))
        found = F.when(same_hour & same_day, 0).when(any_hour & same_day, 1).when(any_day & same_hour, 2)
        return found.when(any_hour & any_day, 3) if relax == "both" else found

    ranked = F.transform("_p", lambda p: F.struct(step(p).alias("step"), p["pickup_hr_ksa"].alias("h"), p["dow"].alias("d"), p["prior_p50"].alias("p50"), p["n_prior"].alias("n")))
    base = join_keys(base, lists, keys).withColumn("_f", F.array_min(F.filter(ranked, lambda x: x["step"].isNotNull())))
    return base.withColumns({"n_prior": F.coalesce("n_prior", "_f.n"), "prior_p50": F.coalesce("prior_p50", "_f.p50")}).drop("_f", "_p")


def attach(base: DataFrame, tiers: Sequence[tuple[DataFrame, Sequence[str]]], relax: str = DEFAULT.prior_relax) -> DataFrame:
    """Priors by tier, the first that has one; then the parent's value, with n_prior 0."""
    base = base.withColumns({"prior_p50": F.lit(None).cast("double"), "n_prior": F.lit(None).cast("long")})
    for prior, keys in tiers:
        base = _merge(base, prior, keys, relax)
    return base.withColumns({"n_prior": F.coalesce("n_prior", F.lit(0)), "prior_p50": F.coalesce("prior_p50", "parent_value")})


def blend(base: DataFrame, n0: int, n0_prep: int) -> DataFrame:
    num = F.col("n_cell") * F.coalesce("value_cell", "parent_value") + F.lit(float(n0)) * F.col("parent_value") + F.lit(float(n0_prep)) * F.col("prior_p50")
    return base.withColumn("value_smoothed", num / (F.col("n_cell") + n0 + n0_prep))
