"""The whole estimate: each table and each leg, built from the enriched orders when it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import Part, many_medians, recency_weight, with_recency
from tramo.operators import diagnostics, lookup, ml, priors, smoothing
from tramo.operators.split import temporal_split
from tramo.params import DEFAULT, LIMITS, Params


def with_legs(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Hours, weekday, buckets and minutes of all legs; hours are those of the parameter's zone."""
    end = F.coalesce("dropoff_arrived_ksa", "order_delivered_ksa")
    accepted, created, arrived, left = (F.col(c) for c in ("last_accepted_ksa", "order_created_ksa", "pickup_arrived_ksa", "pickup_departure_ksa"))
    df = df.withColumns(
        {
            "order_hr_ksa": X.hour_in(created, p.hour_zone),
            "dow": X.weekday_in(created, p.hour_zone),
            "pickup_hr_ksa": X.hour_in(left, p.hour_zone),
            "t1_actual_min": X.minutes_between(accepted, created),
            "t2_actual_min": X.minutes_between(left, accepted),
            "t3_actual_min": X.minutes_between(end, left),
            "ETA_actual_min": X.minutes_between(end, created),
            "t2a_actual_min": X.minutes_between(arrived, accepted),
            "t2b_actual_min": X.minutes_between(left, arrived),
            "stack_bkt": X.stacking_bucket(F.col("stacking_order_count")),
            "t2_dist_bin": X.dist_label(F.col("t2_osrm_distance_km")),
            "t3_dist_bin": X.dist_label(F.col("t3_osrm_distance_km")),
            "t3_dist_haversine_km": X.haversine_km(F.col("pickup_lat"), F.col("pickup_lon"), F.col("dropoff_lat"), F.col("dropoff_lon")),
        }
    )
    reason = X.coord_reason(*[F.col(c) for c in ("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "t3_osrm_distance_km", "t3_dist_haversine_km")])
    df = df.withColumns({"is_peak": X.is_peak(F.col("pickup_hr_ksa")), "t3_coord_reason": reason})
    return df.withColumn("t3_coord_flag", (F.col("t3_coord_reason") != "").cast("int"))


def learn_rows(df: DataFrame) -> DataFrame:
    """A row for each kind that an order counts for (t2a, t3: minutes by routed ones; t3 also minutes; dwell, t2b, t1: minutes), with the keys of all tables and the time that counts."""
    none = F.lit(None)

    def ratio(leg: str, low: tuple[float, float], routed_in: tuple[float, float], ts: str, more) -> Column:
        routed, km, actual = (F.col(c) for c in (f"{leg[:2]}_osrm_duration_min", f"{leg[:2]}_osrm_distance_km", f"{leg}_actual_min"))
        ok = actual.between(*low) & routed.between(*routed_in) & km.isNotNull() & F.col("pickup_hr_ksa").isNotNull() & F.col("zone_name_en").isNotNull() & more
        return kind(leg, ok, F.col(f"{leg[:2]}_dist_bin"), actual / routed, actual if leg == "t3" else none, F.coalesce(ts, "order_created_ksa"))

    def kind(name: str, ok, dist_bin, value, minutes, ts) -> Column:
        row = F.struct(F.lit(name).alias("kind"), dist_bin.cast("string").alias("dist_bin"), value.cast("double").alias("value"), minutes.cast("double").alias("minutes"), ts.cast("timestamp").alias("ts"))
        return F.when(ok, row)

    arrived, delivered, t2b, t1 = (F.col(c) for c in ("dropoff_arrived_ksa", "order_delivered_ksa", "t2b_actual_min", "t1_actual_min"))
    every = [
        ratio("t2a", (0.2, 120.0), (0.2, 90.0), "last_accepted_ksa", F.lit(True)),
        ratio("t3", (0.5, 180.0), (0.2, 150.0), "pickup_departure_ksa", F.col("t3_coord_flag") == 0),
        kind("dwell", arrived.isNotNull() & delivered.isNotNull(), none, X.clip(X.minutes_between(delivered, arrived), *LIMITS["T4"]), none, none),
        kind("t2b", t2b.between(0, 90) & F.col("pickup_hr_ksa").isNotNull(), none, t2b, none, none),
        kind("t1", t1.between(0, 60), none, t1, none, none),
    ]
    keys = ["zone_name_en", "shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow", "is_peak"]
    return df.select(*keys, F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def dwell_rows(df: DataFrame) -> DataFrame:
    d = df.where("dropoff_arrived_ksa is not null and order_delivered_ksa is not null")
    return d.withColumn("dwell_min", X.clip(X.minutes_between(F.col("order_delivered_ksa"), F.col("dropoff_arrived_ksa")), *LIMITS["T4"]))


@dataclass
class Delivery:
    """orders: enriched. keep(df, name) may write a table and read it back; by default plans stay lazy."""

    orders: DataFrame
    p: Params = DEFAULT
    t3_prior: DataFrame | None = None
    prep_order: DataFrame | None = None
    prep_shop: DataFrame | None = None
    prep_vertical: DataFrame | None = None
    t1_model: ml.Fitted | None = None
    t2b_model: ml.Fitted | None = None
    keep: Callable[[DataFrame, str], DataFrame] = field(default=lambda df, name: df)

    @cached_property
    def legs(self) -> DataFrame:
        # expressions over the orders' own columns: each reader takes the few that it needs, and nothing is written
        return with_legs(self.orders, self.p)

    @cached_property
    def facts(self) -> DataFrame:
        """The legs, written: what reads them more than once, or looks them up, has plain columns."""
        return self.keep(self.legs, "facts")

    @cached_property
    def learnt(self) -> DataFrame:
        """What medians are learnt from, narrow, in one pass over the orders: a row for each kind that an order counts for."""
        return self.keep(learn_rows(self.facts), "learnt")

    @cached_property
    def weighted(self) -> list[list[DataFrame]]:
        """Recency-weighted medians of all tables that are learnt from rows: ratios of both legs, and the third one's minutes with their parents."""
        half_lives = {"t2a": self.p.half_life_t2a, "t3": self.p.half_life_t3}
        ref = self.learnt.where(F.col("kind").isin(*half_lives)).groupBy(F.col("kind").alias("_kind")).agg(F.max("ts").alias("_ref"))  # two rows
        rows = self.learnt.join(F.broadcast(ref), F.col("kind") == F.col("_kind"))
        weight = F.coalesce(*[F.when(F.col("kind") == k, recency_weight(F.col("ts"), F.col("_ref"), h)) for k, h in half_lives.items()])
        rows = rows.withColumn("w", weight)
        cell = [("zone_name_en", "pickup_hr_ksa", "dist_bin")]
        t3 = rows.where("kind = 't3'")
        return many_medians([Part(rows.where("kind = 't2a'"), cell, "value", "w"), Part(t3, cell, "value", "w"), Part(t3, smoothing.BASELINE_KEYS, "minutes", "w")], self.keep)

    @cached_property
    def plain(self) -> list[list[DataFrame]]:
        """Interpolated medians: dwell by its keys, waiting by its cells, the first leg overall."""
        of = lambda kind: self.learnt.where(F.col("kind") == kind)
        cell = [("shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow")]
        return many_medians([Part(of("dwell"), smoothing.DWELL_KEYS, "value"), Part(of("t2b"), cell, "value"), Part(of("t1"), [()], "value")], self.keep)

    @cached_property
    def t2a_cells(self) -> DataFrame:
        return self.weighted[0][0].select("zone_name_en", "pickup_hr_ksa", "dist_bin", F.col("v").alias("ratio_p50"), "n")

    @cached_property
    def t3_cells(self) -> DataFrame:
        return self.weighted[1][0].select("zone_name_en", "pickup_hr_ksa", "dist_bin", F.col("v").alias("ratio_p50"), "n")

    @cached_property
    def cell_parents(self) -> list[list[DataFrame]]:
        """Medians of cells, by the levels of both ratios and of the waiting leg."""
        return many_medians([smoothing.ratio_parents(self.t2a_cells), smoothing.ratio_parents(self.t3_cells), smoothing.value_parents(self.t2b_cells)], self.keep)

    @cached_property
    def coarser(self) -> list[list[DataFrame]]:
        """What lookups fall back to, of the three tables that need no other."""
        return many_medians([lookup.ratio_part(self.t2a_smoothed), lookup.ratio_part(self.t3_smoothed), lookup.baseline_part(self.t3_baseline)], self.keep)

    @cached_property
    def t2a_smoothed(self) -> DataFrame:
        return self.keep(smoothing.smooth_ratios(self.t2a_cells, self.p.n0_t2a, found=self.cell_parents[0]), "t2a_smoothed")

    @cached_property
    def t3_rows(self) -> DataFrame:
        return self.learnt.where("kind = 't3'").select("zone_name_en", "pickup_hr_ksa", "dist_bin", F.col("minutes").alias("t3_actual_min"), F.col("value").alias("ratio"), "ts")

    @cached_property
    def t3_smoothed(self) -> DataFrame:
        return self.keep(smoothing.smooth_ratios(self.t3_cells, self.p.n0_t3, self.t3_prior, self.p.n0_t3_prior, self.p.prior_mode, self.cell_parents[1]), "t3_smoothed")

    @cached_property
    def t3_baseline(self) -> DataFrame:
        return self.keep(smoothing.t3_baseline(self.weighted[2], self.p.n0_t3), "t3_baseline")

    @cached_property
    def dwell(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return smoothing.dwell_of(self.plain[0], self.p.n0_dwell)

    @cached_property
    def t2b_cells(self) -> DataFrame:
        return self.plain[1][0].select("shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow", F.col("v").alias("value_p50"), "n")

    @cached_property
    def t2b_smoothed(self) -> DataFrame:
        return self.keep(smoothing.smooth_values(self.t2b_cells, self.p.n0_t2b, self.cell_parents[2]), "t2b_smoothed")

    @cached_property
    def prep_priors(self) -> list[tuple[DataFrame, list[str]]]:
        rows = []
        if self.prep_order is not None:
            rows.append((priors.from_orders(self.prep_order, self.p), ["shop_id", "sub_vertical_name"]))
        for table, key in ((self.prep_shop, "shop_id"), (self.prep_vertical, "sub_vertical_name")):
            if table is not None:
                rows.append((priors.from_groups(table, key), [key]))
        return list(zip(priors.build(rows, self.p.half_life_prep, self.keep), [keys for _, keys in rows], strict=True))

    @cached_property
    def t2b_blend(self) -> DataFrame:
        base = priors.attach(self.t2b_smoothed, self.prep_priors, self.p.prior_relax)
        return self.keep(priors.blend(base, self.p.n0_t2b, self.p.n0_prep), "t2b_blend")

    @cached_property
    def t2a(self) -> DataFrame:
        d = lookup.ratio_lookup(self.facts, self.t2a_smoothed, "t2_dist_bin", "t2a_ratio_p50", "t2a_ratio_src", "t2a_n_cell", self.coarser[0])
        return d.withColumn("T2a_P50", F.coalesce(X.clip(F.col("t2_osrm_duration_min") * F.col("t2a_ratio_p50"), *LIMITS["T2a"]), F.lit(0.0)))

    def add_t2b(self, d: DataFrame) -> DataFrame:
        d = lookup.value_lookup(d, self.t2b_blend, "t2b_value_p50", "t2b_value_src", "t2b_n_cell")
        d = d.withColumn("T2b_base_P50", X.clip(F.col("t2b_value_p50"), *LIMITS["T2b"]))
        d = self.t2b_model.predict(d, "T2b_resid_P50") if self.t2b_model else d.withColumn("T2b_resid_P50", F.lit(0.0))
        d = d.withColumn("T2b_resid_gated", X.gate_resid(F.col("T2b_resid_P50")))
        d = d.withColumn("T2b_P50", X.clip(F.col("T2b_base_P50") + F.col("T2b_resid_gated"), *LIMITS["T2b"]))
        return d.withColumn("T2_P50", X.clip(F.col("T2a_P50") + F.col("T2b_P50"), *LIMITS["T2"]))

    @cached_property
    def t2(self) -> DataFrame:
        return self.keep(self.add_t2b(self.t2a), "t2")

    @cached_property
    def bias_rows(self) -> DataFrame:
        d = temporal_split(self.t2, "order_created_ksa", "order_id", self.p.train_share).where("is_train")
        d = d.withColumn("t2_resid", F.col("t2_actual_min") - (F.coalesce("T2a_P50", F.lit(0.0)) + F.coalesce("T2b_P50", F.lit(0.0))))
        d = d.where("t2_resid is not null and pickup_hr_ksa is not null and zone_name_en is not null")
        d = d.select("zone_name_en", "pickup_hr_ksa", "stack_bkt", "order_created_ksa", "t2_resid")
        return with_recency(self.keep(d, "bias_rows"), F.col("order_created_ksa"), self.p.half_life_bias)

    @cached_property
    def bias_map(self) -> DataFrame:
        return self.keep(smoothing.bias_map(self.bias_rows, self.p.n0_bias, self.keep), "bias_map")

    def add_bias(self, d: DataFrame) -> DataFrame:
        d = lookup.bias_lookup(d, self.bias_map, "T2_bias_corr", self.p)
        return d.withColumn("T2_P50_CORR", X.clip(F.col("T2_P50") + F.col("T2_bias_corr"), *LIMITS["T2"]))

    def add_t3(self, d: DataFrame) -> DataFrame:
        d = lookup.ratio_lookup(d, self.t3_smoothed, "t3_dist_bin", "t3_ratio_p50", "t3_ratio_source", "t3_n_cell", self.coarser[1])
        d = d.withColumn("T3_osrmratio_P50", X.clip(F.col("t3_osrm_duration_min") * F.col("t3_ratio_p50"), *LIMITS["T3"]))
        d = lookup.baseline_lookup(d, self.t3_baseline, "_base", "_base_src", self.coarser[2])
        bad = F.col("t3_coord_flag") == 1
        return d.withColumns(
            {
                "t3_pred_mode": F.when(bad, "zone_hour_fallback").otherwise("osrm_ratio"),
                "T3_base_P50": F.when(bad, X.clip(F.col("_base"), *LIMITS["T3"])).otherwise(F.col("T3_osrmratio_P50")),
                "t3_ratio_source_fallback": F.when(bad, F.col("_base_src")).otherwise("osrm_ratio"),
            }
        ).drop("_base", "_base_src")

    def add_t4(self, d: DataFrame) -> DataFrame:
        return lookup.with_dwell(d, *self.dwell)

    def add_t1(self, d: DataFrame) -> DataFrame:
        if self.t1_model:
            return self.t1_model.predict(d, "T1_P50")
        one = d.sparkSession.range(1).join(self.plain[2][0].select("v"), F.lit(True), "left").select(F.coalesce("v", F.lit(5.0)).alias("T1_P50"))
        return d.crossJoin(F.broadcast(one))

    def add_eta(self, d: DataFrame) -> DataFrame:
        d = d.withColumn("T3_P50", F.col("T3_base_P50") + F.col("T4_dwell_P50"))
        return d.withColumns({"ETA_P50": F.col("T1_P50") + F.col("T2_P50") + F.col("T3_P50"), "ETA_P50_CORR": F.col("T1_P50") + F.col("T2_P50_CORR") + F.col("T3_P50")})

    @cached_property
    def predictions(self) -> DataFrame:
        d = self.add_t4(self.add_t3(self.add_bias(self.t2)))
        return self.keep(self.add_eta(self.add_t1(d)), "predictions")

    def fit_t1(self, trees: int = 600) -> ml.Fitted:
        """The first leg's model; keep should write tables where models are fitted."""
        return ml.fit(self.facts.where("t1_actual_min between 0 and 60"), ml.t1_spec(trees), self.p.min_train_t1)

    def fit_t2b(self, trees: int = 500) -> ml.Fitted | None:
        """The model of the waiting leg's residual, from the earlier share of its rows; None (a residual of 0) if all of them are too few."""
        if self._residual.limit(self.p.min_train_resid).count() < self.p.min_train_resid:
            return None
        return ml.fit(self.keep(self.t2b_rows.where("is_train"), "train"), ml.t2b_spec(self.p.leaky_features, trees))

    @property
    def _residual(self) -> DataFrame:
        d = self.t2.where("t2b_actual_min is not null and T2b_base_P50 is not null")
        return d.withColumn("t2b_resid", X.clip(F.col("t2b_actual_min") - F.col("T2b_base_P50"), -10.0, 30.0))

    @property
    def t2b_rows(self) -> DataFrame:
        """The waiting leg's residuals, and which of them are to learn from: the earlier share."""
        return temporal_split(self._residual, "order_created_ksa", "order_id", self.p.train_share)

    def fit_models(self, t1_iter: int = 600, t2b_iter: int = 500) -> Delivery:
        """The same with fitted models of the first leg and of the waiting leg's residual."""
        return self.with_models(self.fit_t1(t1_iter), self.fit_t2b(t2b_iter))

    def with_models(self, t1: ml.Fitted | None, t2b: ml.Fitted | None) -> Delivery:
        """The same with these models. Tables that no model touches are shared, as far as they have been built."""
        new = replace(self, t1_model=t1, t2b_model=t2b)
        new.__dict__.update({k: v for k, v in self.__dict__.items() if k in UNTOUCHED})
        return new

    @cached_property
    def held_out(self) -> DataFrame:
        """The predictions of the later share of the orders, from which no bias and no residual was learnt."""
        return temporal_split(self.predictions, "order_created_ksa", "order_id", self.p.train_share).where("not is_train").drop("is_train")


    def unseen(self, share: float | None = None, upto: float = 1.0) -> Delivery:
        """The plan of the orders from one share of all, by time, to another, by tables that only the orders before them taught.

        Ratios, baseline, dwell, waiting medians, priors, bias and the first leg's median are those of the earlier orders
        (preparation times by order too, where they name their orders). Models aren't fitted.
        """
        share = self.p.train_share if share is None else share
        when = self.orders.select("order_id", "order_created_ksa")
        early = temporal_split(when, "order_created_ksa", "order_id", share, "_early")
        late = temporal_split(when, "order_created_ksa", "order_id", upto, "_late") if upto < 1 else when.withColumn("_late", F.lit(True))
        early = self.keep(early.where("_early").select("order_id"), "early")
        late = late.where("_late").select("order_id").join(early, "order_id", "left_anti")
        prep = self.prep_order
        if prep is not None and "order_id" in prep.columns:
            prep = prep.join(early, "order_id", "left_semi")
        taught = replace(self, orders=self.orders.join(early, "order_id", "left_semi"), prep_order=prep, t1_model=None, t2b_model=None)
        new = replace(taught, orders=self.orders.join(late, "order_id", "left_semi"))
        new.__dict__.update({k: getattr(taught, k) for k in TABLES})
        return new

    @cached_property
    def late(self) -> Delivery:
        """The plan of the later share of the orders, by what the earlier ones taught."""
        return self.unseen()

    def rolling(self, origins: Sequence[float] = (0.6, 0.8)) -> DataFrame:
        """Errors by leg of the orders after each origin (a share of all orders) up to the next one, by what was known at it: origin, and the columns of by_leg."""
        ends = [*origins[1:], 1.0]
        parts = [diagnostics.by_leg(self.unseen(a, b).predictions).withColumn("origin", F.lit(float(a))) for a, b in zip(origins, ends, strict=True)]
        return reduce(DataFrame.unionByName, parts)


#: Tables that orders teach and others are looked up in.
TABLES = ("weighted", "plain", "cell_parents", "coarser", "t2a_cells", "t2a_smoothed", "t3_cells", "t3_smoothed", "t3_baseline", "dwell", "t2b_cells", "t2b_smoothed", "prep_priors", "t2b_blend", "bias_map")
#: Tables of the plan that don't depend on a fitted model.
UNTOUCHED = ("legs", "facts", "learnt", "weighted", "plain", "cell_parents", "coarser", "t2a_cells", "t2a_smoothed", "t3_rows", "t3_cells", "t3_smoothed", "t3_baseline", "dwell", "t2b_cells", "t2b_smoothed", "prep_priors", "t2b_blend", "t2a")

# What is written for each order, as far as it exists.
PREDICTION_COLUMNS = (
    "order_id", "zone_name_en", "pickup_hr_ksa", "is_peak", "dow", "stack_bkt",
    "T1_P50", "t1_actual_min", "T2a_P50", "t2a_ratio_p50", "t2a_ratio_src", "t2a_n_cell",
    "T2b_base_P50", "T2b_resid_P50", "T2b_resid_gated", "T2b_P50", "t2b_n_cell", "t2a_actual_min", "t2b_actual_min",
    "T2_P50", "T2_bias_corr", "T2_P50_CORR", "t2_actual_min",
    "t3_coord_flag", "t3_coord_reason", "t3_dist_haversine_km", "t3_pred_mode", "t3_ratio_source", "t3_ratio_source_fallback",
    "T3_osrmratio_P50", "T3_base_P50", "T4_dwell_P50", "T3_P50", "t3_actual_min", "ETA_P50", "ETA_P50_CORR", "ETA_actual_min",
)


def order_predictions(df: DataFrame) -> DataFrame:
    return df.select([c for c in PREDICTION_COLUMNS if c in df.columns])


def blend_summary(blend: DataFrame) -> DataFrame:
    """The columns of the blend that tell how each cell came about."""
    keys = ["shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow"]
    return blend.select(*keys, "n_cell", "parent_value", "prior_p50", "n_prior", F.col("value_smoothed").alias("value_blended"))


def ratio_sources(predictions: DataFrame) -> DataFrame:
    """Where each order's two ratios and its dwell came from."""
    return predictions.select("order_id", F.col("t2a_ratio_src").alias("t2_ratio_source"), "t3_ratio_source", "dwell_source")
