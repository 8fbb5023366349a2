"""The earlier model: ratios from calibration tables, preparation features, a residual model of the second leg, and guards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import with_quantiles
from tramo.operators import lookup, ml, smoothing
from tramo.params import DEFAULT, LIMITS, Params
from tramo.plans.delivery import dwell_rows, with_legs

# Rows that draw a cell to its parent, in the earlier model.
N0_T2, N0_T3, N0_DWELL = 50, 30, 80


def residual_rows(d: DataFrame, ratio: str = "t2a_ratio_p50") -> DataFrame:
    """d: legs with a ratio. The second leg's residual against the unclipped routed estimate."""
    base = F.col("t2_osrm_duration_min") * F.col(ratio)
    d = d.withColumn("T2_osrm_ratio_pred", base).where(F.col("t2_actual_min").between(*LIMITS["T2"]) & base.isNotNull())
    return d.withColumn("t2_resid", X.clip(F.col("t2_actual_min") - base, -15.0, 45.0))


def guard_means(d: DataFrame) -> DataFrame:
    full = residual_rows(d).where("zone_name_en is not null")
    return full.groupBy("zone_name_en", "is_peak", "stack_bkt").agg(F.avg("t2_resid").alias("guard_mean"))


def guard_adjust(d: DataFrame, means: DataFrame, worst_zones: Sequence[str]) -> DataFrame:
    d = d.join(means, ["zone_name_en", "is_peak", "stack_bkt"], "left")
    return d.withColumn("guard_adj", X.peak_guard(F.col("zone_name_en"), F.col("is_peak"), F.col("guard_mean"), worst_zones))


def shop_prep_stats(prep: DataFrame, orders: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """By chain: median, quartiles, their distance and the count of order-level preparation minutes. keep may write the rows, which are read more than once."""
    rows = prep.select("order_id", "prep_time_min").dropna().join(orders.select("order_id", F.col("mbo_chain_id").cast("string").alias("mbo_chain_id")).dropna(), "order_id")
    rows = keep(rows.select("mbo_chain_id", "prep_time_min"), "prep_rows")
    wanted = {f"prep_shop_p{q}": ("prep_time_min", q / 100) for q in (50, 25, 75)}
    d = with_quantiles(rows, ["mbo_chain_id"], wanted, F.count("prep_time_min").alias("prep_shop_cnt"))
    return d.withColumn("prep_shop_iqr", F.col("prep_shop_p75") - F.col("prep_shop_p25"))


def attach_prep(d: DataFrame, shop: DataFrame, vertical: DataFrame, stats: DataFrame) -> DataFrame:
    """Means by chain (mbo_chain_id, prep_shop_mean) and vertical (sub_vertical_name, prep_vert_mean), and the statistics.

    Each table has a row for a key at most; chains are compared as strings; a missing key has no features.
    """
    d = d.withColumn("_chain", F.col("mbo_chain_id").cast("string"))
    d = d.join(shop.select(F.col("mbo_chain_id").cast("string").alias("_chain"), "prep_shop_mean"), "_chain", "left").join(vertical.select("sub_vertical_name", "prep_vert_mean"), "sub_vertical_name", "left")
    return d.join(stats.select(F.col("mbo_chain_id").alias("_chain"), "prep_shop_p50", "prep_shop_iqr", "prep_shop_cnt"), "_chain", "left").drop("_chain")


def second_leg(d: DataFrame, resid: str = "T2_resid_P50") -> DataFrame:
    return d.withColumn("T2_P50", X.clip(F.col("T2_osrm_ratio_pred") + F.col(resid) + F.col("guard_adj"), *LIMITS["T2"]))


@dataclass
class Earlier:
    """orders: enriched; calib_t2, calib_t3: ratio_p50 and n by hour, zone and distance; prep tables as attach_prep has them."""

    orders: DataFrame
    calib_t2: DataFrame
    calib_t3: DataFrame
    prep_order: DataFrame
    prep_shop: DataFrame
    prep_vertical: DataFrame
    worst_zones: Sequence[str] = ()
    p: Params = DEFAULT
    t1_model: ml.Fitted | None = None
    t2_model: ml.Fitted | None = None
    keep: Callable[[DataFrame, str], DataFrame] = field(default=lambda df, name: df)

    @cached_property
    def t2_smoothed(self) -> DataFrame:
        return self.keep(smoothing.smooth_ratios(self.calib_t2, N0_T2), "t2_smoothed")

    @cached_property
    def t3_smoothed(self) -> DataFrame:
        return self.keep(smoothing.smooth_ratios(self.calib_t3, N0_T3), "t3_smoothed")

    @cached_property
    def legs(self) -> DataFrame:
        """The legs, written: lookups have plain columns."""
        return self.keep(with_legs(self.orders, self.p), "legs")

    @cached_property
    def features(self) -> DataFrame:
        """Legs with the routed estimate of the second one and all preparation features."""
        d = lookup.ratio_lookup(self.legs, self.t2_smoothed, "t2_dist_bin", "t2_ratio_p50", "t2_ratio_source", "t2_n_cell")
        d = d.withColumn("T2_osrm_ratio_pred", F.col("t2_osrm_duration_min") * F.col("t2_ratio_p50"))
        return self.keep(attach_prep(d, self.prep_shop, self.prep_vertical, self.keep(shop_prep_stats(self.prep_order, self.orders, self.keep), "prep_stats")), "features")

    @cached_property
    def train(self) -> DataFrame:
        return residual_rows(self.features, "t2_ratio_p50")

    @cached_property
    def guards(self) -> DataFrame:
        full = self.train.where("zone_name_en is not null")
        return self.keep(full.groupBy("zone_name_en", "is_peak", "stack_bkt").agg(F.avg("t2_resid").alias("guard_mean")), "guards")

    def fit_t2(self, trees: int = 600) -> ml.Fitted:
        return ml.fit(self.train, ml.t2_legacy_spec(trees))

    def fit_t1(self, trees: int = 600) -> ml.Fitted:
        return ml.fit(self.features.where("t1_actual_min between 0 and 60"), ml.t1_spec(trees), self.p.min_train_t1)

    @cached_property
    def predictions(self) -> DataFrame:
        """All orders; without models the first leg is its median, and the residual of the second one 0."""
        d = self.t2_model.predict(self.features, "T2_resid_P50") if self.t2_model else self.features.withColumn("T2_resid_P50", F.lit(0.0))
        d = second_leg(guard_adjust(d, self.guards, self.worst_zones))
        d = lookup.ratio_lookup(d, self.t3_smoothed, "t3_dist_bin", "t3_ratio_p50", "t3_ratio_source", "t3_n_cell")
        d = d.withColumn("T3_base_P50", X.clip(F.col("t3_osrm_duration_min") * F.col("t3_ratio_p50"), *LIMITS["T3"]))
        d = lookup.with_dwell(d, *smoothing.dwell(dwell_rows(self.features), N0_DWELL))
        first = self.t1_model or ml.constant(self.features.where("t1_actual_min between 0 and 60"), "t1_actual_min")
        d = first.predict(d, "T1_P50").withColumn("T3_P50", F.col("T3_base_P50") + F.col("T4_dwell_P50"))
        return self.keep(d.withColumn("ETA_P50", F.col("T1_P50") + F.col("T2_P50") + F.col("T3_P50")), "earlier")


# What the earlier model writes for each order.
PREDICTION_COLUMNS = (
    "order_id", "zone_name_en", "pickup_hr_ksa", "is_peak", "dow", "T1_P50", "t1_actual_min",
    "T2_osrm_ratio_pred", "T2_resid_P50", "guard_adj", "T2_P50", "t2_actual_min", "T3_base_P50", "T4_dwell_P50", "T3_P50", "t3_actual_min",
    "ETA_P50", "ETA_actual_min", "t2_ratio_p50", "t2_ratio_source", "t3_ratio_p50", "t3_ratio_source", "dwell_source",
    "prep_shop_mean", "prep_vert_mean", "prep_shop_p50", "prep_shop_iqr", "prep_shop_cnt",
)
#: The earlier model's legs for diagnostics.by_leg.
LEGS = (("T1", "t1_actual_min", "T1_P50", "T1"), ("T2", "t2_actual_min", "T2_P50", "T2"), ("T3", "t3_actual_min", "T3_P50", "T3"), ("ETA", "ETA_actual_min", "ETA_P50", "ETA"))
