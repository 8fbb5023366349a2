"""Errors by leg, by zone and hour, bands of errors, and coverage; all but medians in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions.wstats import with_quantiles
from tramo.params import DEFAULT, METRIC_RANGES, Params

LEGS = (("T1", "t1_actual_min", "T1_P50", "T1"), ("T2_raw", "t2_actual_min", "T2_P50", "T2"), ("T2_corrected", "t2_actual_min", "T2_P50_CORR", "T2"), ("T3", "t3_actual_min", "T3_P50", "T3"), ("ETA_raw", "ETA_actual_min", "ETA_P50", "ETA"), ("ETA_corrected", "ETA_actual_min", "ETA_P50_CORR", "ETA"))


def by_leg(df: DataFrame, legs: Sequence[tuple[str, str, str, str]] = LEGS) -> DataFrame:
    """leg, rows (in range, with or without a prediction), MAE and Median_AE."""
    aggs, stack, errors = [], [], {}
    for k, (leg, actual, pred, kind) in enumerate(legs):
        on = F.col(actual).between(*METRIC_RANGES[kind])
        err = F.when(on, F.abs(F.col(actual) - F.col(pred)))
        aggs += [F.count(F.when(on, 1)).alias(f"r{k}"), F.avg(err).alias(f"m{k}")]
        errors[f"_e{k}"] = err
        stack.append(f"'{leg}', r{k}, m{k}, d{k}")
    medians = {f"d{k}": (f"_e{k}", 0.5) for k in range(len(legs))}
    return with_quantiles(df.withColumns(errors), [], medians, *aggs).selectExpr(f"stack({len(legs)}, {', '.join(stack)}) as (leg, rows, MAE, Median_AE)")


def by_zone_hour(df: DataFrame, pred: str = "ETA_P50") -> DataFrame:
    err = F.abs(F.col("ETA_actual_min") - F.col(pred))
    full = df.where("zone_name_en is not null and pickup_hr_ksa is not null")
    return with_quantiles(full.withColumn("_e", err), ["zone_name_en", "pickup_hr_ksa"], {"Median_AE": ("_e", 0.5)}, F.count(F.lit(1)).alias("rows"), F.avg("_e").alias("MAE"))


def coverage(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    share = lambda on: F.avg(F.coalesce(on, F.lit(False)).cast("double")) * 100
    of = lambda c: share(F.col(c) >= p.coverage_min_n) if c in df.columns else F.lit(None).cast("double")
    return df.agg(of("t2a_n_cell").alias("t2a_pct"), of("t2b_n_cell").alias("t2b_pct"), share(F.abs("T2_bias_corr") >= p.bias_min_abs).alias("bias_pct"))


def coverage_text(row, p: Params = DEFAULT) -> str:
    """The coverage report; a share that there is no column for is n/a."""
    t2a = "T2a coverage: n/a" if row["t2a_pct"] is None else f"T2a coverage: {row['t2a_pct']:.1f}% of orders hit cells with n_cell >= {p.coverage_min_n}"
    t2b = "T2b coverage: n/a" if row["t2b_pct"] is None else f"T2b (shop×hour×dow) direct-cell coverage: {row['t2b_pct']:.1f}% with n_cell >= {p.coverage_min_n}"
    bias = f"T2 bias activation rate: {row['bias_pct'] or 0:.1f}% of orders (|bias| >= {p.bias_min_abs} & N>= {p.bias_min_n})"
    return "\n".join([t2a, t2b, bias]) + "\n"


def error_bands(df: DataFrame, pred: str = "ETA_P50_CORR", bands: Sequence[float] = (2, 5, 10, 15)) -> DataFrame:
    """Orders within each number of minutes, cumulative, and over the last."""
    err = F.abs(F.col("ETA_actual_min") - F.col(pred))
    aggs = [F.count(F.when(err <= b, 1)).alias(f"b{k}") for k, b in enumerate(bands)] + [F.count(F.when(err > bands[-1], 1)).alias("over"), F.count(err).alias("n")]
    rows = ", ".join([f"'<={b:g}', b{k}" for k, b in enumerate(bands)] + [f"'>{bands[-1]:g}', over"])
    one = df.agg(*aggs).selectExpr(f"stack({len(bands) + 1}, {rows}) as (band, orders)", "n")
    return one.select("band", "orders", (F.try_divide(F.col("orders") * 100.0, F.col("n"))).alias("pct"))
