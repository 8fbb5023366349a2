"""Queries of the library's own operators over derived delivery orders, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo import oracles as O
from tramo.functions import exprs as X
from tramo.functions.wstats import weighted_median, with_recency
from tramo.operators import boost, diagnostics, enrich, ml, priors, smoothing
from tramo.operators.split import temporal_split
from tramo.params import DEFAULT
from tramo.plans import legacy
from tramo.plans.delivery import Delivery, blend_summary, order_predictions, ratio_sources
from tramo.sources import fixture
from tramo.sources.routes import DetourRoutes
from tramo.streaming.score import score_t3
from tramo.tables import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6
WORST_ZONES = ("Z0", "Z1", "Z2", "Z3", "Z4", "Z5")


def delivery(spark: SparkSession, sf_dir: str, **changes) -> Delivery:
    # the derived orders stand for a table that would be read: a scan, a join with a small table and expressions
    d = fixture.deliveries(spark, sf_dir)
    order, shop, vertical = fixture.prep_tables(spark, d)
    return Delivery(d, replace(DEFAULT, **changes), prep_order=order, prep_shop=shop, prep_vertical=vertical, keep=stage)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), PLACES).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Delivery], DataFrame]], Query]:
    """A query over a Delivery; sql: its rows, with doubles as they come."""

    def wrap(f: Callable[[Delivery], DataFrame]) -> Query:
        QUERIES[name] = query = lambda spark, sf_dir: rounded(f(delivery(spark, sf_dir)))
        if sql is not None:
            # columns are rounded here, in whatever type they are, as on the other side
            ORACLE_SQL[name] = sql
        return query

    return wrap


def cols(df: DataFrame, names: str) -> DataFrame:
    return df.select(*names.split())


def sql(names: str, source: str, **doubles: str) -> str:
    """Select names from a named expression; those written with a ~ are rounded; doubles: rounded expressions."""
    out = [f"round({n[1:]}, {PLACES}) as {n[1:]}" if n[0] == "~" else n for n in names.split()] + [f"round({x}, {PLACES}) as {n}" for n, x in doubles.items()]
    return O.query(f"select {', '.join(out)} from {source}")


def both(name: str, names: str, source: str) -> Callable[[Callable[[Delivery], DataFrame]], Query]:
    """The same columns from the plan and from a named expression."""
    plain = names.replace("~", "")
    return lambda f: register(name, sql(names, source))(lambda d: cols(f(d), plain))


both("leg_minutes", "order_id ~t1_actual_min ~t2_actual_min ~t3_actual_min ~ETA_actual_min ~t2a_actual_min ~t2b_actual_min order_hr_ksa pickup_hr_ksa dow is_peak stack_bkt", "c_legs")(lambda d: d.legs)
both("haversine_km", "order_id ~t3_dist_haversine_km", "c_legs")(lambda d: d.legs)
both("dist_bin", "order_id t2_dist_bin t3_dist_bin", "c_legs")(lambda d: d.legs)
both("coord_qa", "order_id t3_coord_flag t3_coord_reason", "c_legs")(lambda d: d.legs)
register("coord_qa_counts", O.query("select t3_coord_reason, count(*) as n from c_legs group by all"))(lambda d: d.legs.groupBy("t3_coord_reason").agg(F.count(F.lit(1)).alias("n")))
register("dist_bin_cut", O.query(f"select order_id, {O.dist('t3_osrm_distance_km - 1')} as bin from c_d"))(lambda d: d.orders.select("order_id", X.dist_cut(F.col("t3_osrm_distance_km") - 1).alias("bin")))

both("t2a_cells", "zone_name_en pickup_hr_ksa dist_bin ~ratio_p50 n", "c_t2a_cells")(lambda d: d.t2a_cells)
both("t3_cells", "zone_name_en pickup_hr_ksa dist_bin ~ratio_p50 n", "c_t3_cells")(lambda d: d.t3_cells)
SMOOTHED = "zone_name_en pickup_hr_ksa dist_bin is_peak ~ratio_cell n_cell ~parent_ratio parent_n parent_level ~ratio_prior n_prior ~ratio_smoothed"
both("t2a_smoothed", SMOOTHED, "c_t2a_smoothed")(lambda d: d.t2a_smoothed)


def _with_external(d: Delivery, mode: str) -> DataFrame:
    ext = d.t3_cells.where("pickup_hr_ksa % 3 = 0").select("zone_name_en", F.col("pickup_hr_ksa").alias("pickup_hr"), "dist_bin", (0.5 + F.col("pickup_hr_ksa") / 10.0).alias("ratio"), F.lit(40).cast("long").alias("n_cell"))
    return smoothing.smooth_ratios(d.t3_cells, d.p.n0_t3, ext, d.p.n0_t3_prior, mode)


both("t3_smoothed_balanced", SMOOTHED, "c_t3_balanced")(lambda d: _with_external(d, "balanced"))
both("t3_smoothed_reference", SMOOTHED, "c_t3_reference")(lambda d: _with_external(d, "reference"))
both("t2a_lookup", "order_id ~t2a_ratio_p50 t2a_ratio_src t2a_n_cell ~T2a_P50", "c_t2a")(lambda d: d.t2a)
both("t3_lookup", "order_id ~t3_ratio_p50 t3_ratio_source ~T3_osrmratio_P50", "c_t3_alone")(lambda d: d.add_t3(d.facts))
both("t3_baseline", "zone_name_en pickup_hr_ksa is_peak ~value_cell n_cell ~parent_value parent_n parent_level ~value_smoothed", "c_baseline")(lambda d: d.t3_baseline)
both("t3_baseline_lookup", "order_id t3_pred_mode ~T3_base_P50 t3_ratio_source_fallback", "c_t3_alone")(lambda d: d.add_t3(d.facts))
both("dwell_smoothed", "zone_name_en pickup_hr_ksa ~dwell_cell n_cell ~dwell_parent n_parent ~dwell_smoothed", "c_dwell")(lambda d: d.dwell[0])
both("t4_dwell", "order_id ~T4_dwell_P50 dwell_source", "c_t4_only")(lambda d: d.add_t4(d.facts))
both("t2b_cells", "shop_id sub_vertical_name pickup_hr_ksa dow ~value_p50 n", "c_t2b_cells")(lambda d: d.t2b_cells)
VALUES = "shop_id sub_vertical_name pickup_hr_ksa dow ~value_cell n_cell ~parent_value parent_n parent_level ~value_smoothed"
both("t2b_smoothed", VALUES, "c_t2b_smoothed")(lambda d: d.t2b_smoothed)
both("prior_order", "shop_id sub_vertical_name pickup_hr_ksa dow ~prior_p50 n_prior", "c_prior_order")(lambda d: d.prep_priors[0][0])
both("prior_shop", "shop_id pickup_hr_ksa dow ~prior_p50 n_prior", "c_prior_shop")(lambda d: d.prep_priors[1][0])
both("prior_vertical", "sub_vertical_name pickup_hr_ksa dow ~prior_p50 n_prior", "c_prior_vertical")(lambda d: d.prep_priors[2][0])
both("t2b_blend", VALUES + " ~prior_p50 n_prior", "c_blend")(lambda d: d.t2b_blend)
both("t2b_blend_reference", VALUES + " ~prior_p50 n_prior", "c_blend_reference")(lambda d: priors.blend(priors.attach(d.t2b_smoothed, d.prep_priors, "reference"), d.p.n0_t2b, d.p.n0_prep))
both("t2b_lookup", "order_id ~t2b_value_p50 t2b_value_src t2b_n_cell ~T2b_P50 ~T2_P50", "c_t2")(lambda d: d.t2)
both("temporal_split", "order_id is_train", "c_split")(lambda d: temporal_split(d.legs, "order_created_ksa", "order_id", d.p.train_share))
both("t2_bias_map", "zone_name_en pickup_hr_ksa stack_bkt ~bias_cell n_cell ~parent_bias parent_level ~bias_smoothed", "c_bias")(lambda d: d.bias_map)
both("t2_bias_apply", "order_id ~T2_bias_corr ~T2_P50_CORR", "c_corr")(lambda d: d.add_bias(d.t2))
both(
    "eta_predictions",
    "order_id zone_name_en pickup_hr_ksa is_peak dow stack_bkt ~T1_P50 ~t1_actual_min ~T2a_P50 ~t2a_ratio_p50 t2a_ratio_src t2a_n_cell ~T2b_base_P50 ~T2b_P50 t2b_n_cell ~t2a_actual_min ~t2b_actual_min ~T2_P50 ~T2_bias_corr "
    "~T2_P50_CORR ~t2_actual_min t3_coord_flag t3_coord_reason ~t3_dist_haversine_km t3_pred_mode t3_ratio_source t3_ratio_source_fallback ~T3_osrmratio_P50 ~T3_base_P50 ~T4_dwell_P50 ~T3_P50 ~t3_actual_min ~ETA_P50 ~ETA_P50_CORR ~ETA_actual_min",
    "c_eta",
)(lambda d: order_predictions(d.predictions))


def _leg_sql(source: str, legs: tuple[tuple[str, str, str, str], ...]) -> str:
    one = "select '{0}' as leg, count(*) as rows, round(avg(abs({1} - {2})), 6) as MAE, round(median(abs({1} - {2})), 6) as Median_AE from {5} where {1} between {3} and {4}"
    return O.query(" union all ".join(one.format(leg, a, p, *O.MASKS[k], source) for leg, a, p, k in legs))


# Fixed values, apart from those of the library: legs, their observed and estimated minutes.
_LEGS = (
    ("T1", "t1_actual_min", "T1_P50", "T1"), ("T2_raw", "t2_actual_min", "T2_P50", "T2"), ("T2_corrected", "t2_actual_min", "T2_P50_CORR", "T2"),
    ("T3", "t3_actual_min", "T3_P50", "T3"), ("ETA_raw", "ETA_actual_min", "ETA_P50", "ETA"), ("ETA_corrected", "ETA_actual_min", "ETA_P50_CORR", "ETA"),
)
register("leg_diagnostics_holdout", _leg_sql("c_late", _LEGS))(lambda d: diagnostics.by_leg(d.held_out))
register("leg_diagnostics", _leg_sql("c_eta", _LEGS))(lambda d: diagnostics.by_leg(d.predictions))
register("leg_diagnostics_unseen", _leg_sql("c_u_eta", _LEGS))(lambda d: diagnostics.by_leg(d.late.predictions))
_ZH = "select zone_name_en, pickup_hr_ksa, count(*) as rows, round(avg(abs(ETA_actual_min - {0})), 6) as MAE, round(median(abs(ETA_actual_min - {0})), 6) as Median_AE from c_eta where zone_name_en is not null and pickup_hr_ksa is not null group by all"
register("zone_hour_diagnostics", O.query(_ZH.format("ETA_P50")))(lambda d: diagnostics.by_zone_hour(d.predictions))
register("zone_hour_diagnostics_holdout", O.query(_ZH.format("ETA_P50_CORR").replace("c_eta", "c_late")))(lambda d: diagnostics.by_zone_hour(d.held_out, "ETA_P50_CORR"))
both("eta_unseen", "order_id ~T1_P50 ~T2a_P50 ~T2b_P50 t2b_n_cell ~T2_bias_corr ~T2_P50_CORR ~T3_base_P50 ~T4_dwell_P50 ~ETA_P50_CORR t2a_ratio_src t3_ratio_source", "c_u_eta")(lambda d: d.late.predictions)
register("zone_hour_diagnostics_unseen", O.query(_ZH.format("ETA_P50_CORR").replace("c_eta", "c_u_eta")))(lambda d: diagnostics.by_zone_hour(d.late.predictions, "ETA_P50_CORR"))
both("ratio_sources", "order_id t2_ratio_source t3_ratio_source dwell_source", "(select *, t2a_ratio_src as t2_ratio_source from c_eta) x")(lambda d: ratio_sources(d.predictions))
both("t2b_blend_summary", "shop_id sub_vertical_name pickup_hr_ksa dow n_cell ~parent_value ~prior_p50 n_prior ~value_blended", "(select *, value_smoothed as value_blended from c_blend) x")(lambda d: blend_summary(d.t2b_blend))
register("zone_hour_diagnostics_corrected", O.query(_ZH.format("ETA_P50_CORR")))(lambda d: diagnostics.by_zone_hour(d.predictions, "ETA_P50_CORR"))
_SHARE = "round(100 * avg(case when {0} then 1e0 else 0e0 end), 6) as {1}"
register("coverage", O.query("select " + ", ".join(_SHARE.format(c, n) for c, n in (("t2a_n_cell >= 25", "t2a_pct"), ("t2b_n_cell >= 25", "t2b_pct"), ("abs(T2_bias_corr) >= 0.5", "bias_pct"))) + " from c_corr"))(lambda d: diagnostics.coverage(d.add_bias(d.t2)))
_BAND = "select '{0}' as band, count(*) filter (abs(ETA_actual_min - ETA_P50_CORR) {1}) as orders, round(count(*) filter (abs(ETA_actual_min - ETA_P50_CORR) {1}) * 100e0 / count(abs(ETA_actual_min - ETA_P50_CORR)), 6) as pct from c_eta"
register("error_bands_unseen", O.query(" union all ".join(_BAND.format(b, b.replace("<=", "<= ").replace(">", "> ")) for b in ("<=2", "<=5", "<=10", "<=15", ">15")).replace("c_eta", "c_u_eta")))(lambda d: diagnostics.error_bands(d.late.predictions))
register("error_bands", O.query(" union all ".join(_BAND.format(b, b.replace("<=", "<= ").replace(">", "> ")) for b in ("<=2", "<=5", "<=10", "<=15", ">15"))))(lambda d: diagnostics.error_bands(d.predictions))

register("recency_weights", O.query("select order_id, round(exp(-ln(2e0) / 21e0 * greatest((max(accepted_s) over () - accepted_s) / 86400e0, 0e0)), 6) as w from c_d where accepted_s is not null union all select order_id, 0e0 as w from c_d where accepted_s is null"))(
    lambda d: with_recency(d.orders, F.col("last_accepted_ksa"), 21.0).select("order_id", "w")
)
O.weighted_median("c_wm_zone", "c_t3_wrows", ["zone_name_en"], "ratio", "w", "ratio_p50", "n")
O.weighted_median("c_wm_all", "c_t3_wrows", [], "ratio", "w", "ratio_p50", "n")
register("weighted_median", O.query("select zone_name_en, round(ratio_p50, 6) as ratio_p50, n from c_wm_zone union all select 'all' as zone_name_en, round(ratio_p50, 6) as ratio_p50, n from c_wm_all"))(lambda d: _weighted(d))


def _weighted(d: Delivery) -> DataFrame:
    rows = with_recency(d.t3_rows, F.col("ts"), 21.0)
    one = weighted_median(rows, [], "ratio", "w", "ratio_p50", "n").select(F.lit("all").alias("zone_name_en"), "ratio_p50", "n")
    return weighted_median(rows, ["zone_name_en"], "ratio", "w", "ratio_p50", "n").unionByName(one)


def _enriched(d: Delivery) -> DataFrame:
    return enrich.enrich(d.orders, DetourRoutes())


_CAL = "select hr_ as pickup_hr_ksa, zone_name_en, {bin} as dist_bin, round(median({leg}_ratio), 6) as ratio_p50, round(quantile_cont({leg}_ratio, 0.85), 6) as ratio_p85, count(*) as n, round(median({leg}_km), 6) as osrm_km_p50, round(median({leg}), 6) as actual_min_p50 from c_e3 where hr_ is not null and zone_name_en is not null and {leg}_km < 1e9 and {leg}_ratio is not null group by all"
register("swap_repair", O.query("select order_id, round(pickup_lat, 6) as pickup_lat, round(pickup_lon, 6) as pickup_lon, round(dropoff_lat, 6) as dropoff_lat, round(dropoff_lon, 6) as dropoff_lon from c_e1"))(lambda d: cols(X.repair_swaps(enrich.legs(d.orders), enrich.COORDS), "order_id pickup_lat pickup_lon dropoff_lat dropoff_lon"))
register("route_pairs_distinct", O.query("select pair_key from (select t2_pair_key as pair_key from c_e2 union select t3_pair_key from c_e2) x where pair_key is not null"))(lambda d: enrich.distinct_pairs(enrich.keyed(enrich.legs(d.orders))).select("pair_key"))
_ATT = ", ".join(f"round({leg}_dur, 6) as {leg}_osrm_duration_min, round({leg}_km, 6) as {leg}_osrm_distance_km, round({leg}_ratio, 6) as ratio_actual_over_osrm_{leg}" for leg in ("t2", "t3"))
register("route_attach", O.query(f"select order_id, {_ATT} from c_e3"))(lambda d: cols(_enriched(d), "order_id t2_osrm_duration_min t2_osrm_distance_km ratio_actual_over_osrm_t2 t3_osrm_duration_min t3_osrm_distance_km ratio_actual_over_osrm_t3"))
register("calib_t1", O.query("select cast(((created_s + 10800) // 3600) % 24 as int) as pickup_hr_ksa, zone_name_en, round(median(t1), 6) as t1_p50, round(quantile_cont(t1, 0.85), 6) as t1_p85, count(*) as n from c_e1 where t1 is not null and zone_name_en is not null group by all"))(lambda d: enrich.calibrate_t1(enrich.legs(d.orders)))
register("calib_t2", O.query(_CAL.format(leg="t2", bin=O.dist("t2_km"))))(lambda d: enrich.calibrate_ratios(_enriched(d), "t2"))
register("calib_t3", O.query(_CAL.format(leg="t3", bin=O.dist("t3_km"))))(lambda d: enrich.calibrate_ratios(_enriched(d), "t3"))

both("guard_mean", "zone_name_en is_peak stack_bkt ~guard_mean", "c_guard")(lambda d: legacy.guard_means(d.t2a))
_ADJ = "select f.order_id, round(case when f.zone_name_en in ('Z0', 'Z1', 'Z2', 'Z3', 'Z4', 'Z5') and f.is_peak = 1 and g.guard_mean > 0 then 0.7e0 * g.guard_mean else 0e0 end, 6) as guard_adj from c_legs f left join c_guard g on g.zone_name_en = f.zone_name_en and g.is_peak = f.is_peak and g.stack_bkt = f.stack_bkt"
register("guard_adjust", O.query(_ADJ))(lambda d: cols(legacy.guard_adjust(d.legs, legacy.guard_means(d.t2a), WORST_ZONES), "order_id guard_adj"))
_STAT = "select cast(mbo_chain_id as varchar) as mbo_chain_id, round(median(prep_time_min), 6) as prep_shop_p50, round(quantile_cont(prep_time_min, 0.25), 6) as prep_shop_p25, round(quantile_cont(prep_time_min, 0.75), 6) as prep_shop_p75, count(*) as prep_shop_cnt, round(quantile_cont(prep_time_min, 0.75) - quantile_cont(prep_time_min, 0.25), 6) as prep_shop_iqr from c_po0 join (select order_id, mbo_chain_id from c_d) o using (order_id) group by 1"
register("shop_prep_stats", O.query(_STAT))(lambda d: legacy.shop_prep_stats(d.prep_order, d.orders))


def earlier(d: Delivery) -> legacy.Earlier:
    """The earlier model over the same orders. Means by chain and vertical, which it reads from files, are those of the orders' own preparation times."""
    seen = enrich.enrich(d.orders, DetourRoutes())
    by = d.prep_order.select("order_id", "sub_vertical_name", "prep_time_min").join(d.orders.select("order_id", "mbo_chain_id"), "order_id")
    by = stage(by.select("mbo_chain_id", "sub_vertical_name", "prep_time_min"), "prep")
    shop = by.where("mbo_chain_id % 3 <> 0").groupBy("mbo_chain_id").agg(F.avg("prep_time_min").alias("prep_shop_mean"))
    vertical = by.where("sub_vertical_name <> 'V4'").groupBy("sub_vertical_name").agg(F.avg("prep_time_min").alias("prep_vert_mean"))
    return legacy.Earlier(d.orders, *enrich.ratio_medians(seen, stage), d.prep_order, shop, vertical, WORST_ZONES, d.p, keep=stage)


PREP = "~prep_shop_mean ~prep_vert_mean ~prep_shop_p50 ~prep_shop_iqr prep_shop_cnt"
both("earlier_t2_smoothed", "zone_name_en pickup_hr_ksa dist_bin n_cell parent_level ~ratio_smoothed", "c_v_t2_smoothed")(lambda d: earlier(d).t2_smoothed)
both("earlier_prep", "order_id " + PREP, "c_v_prep")(lambda d: earlier(d).features)
both("earlier_residual_rows", "order_id ~T2_osrm_ratio_pred ~t2_resid dow is_peak " + PREP, "c_v_train")(lambda d: earlier(d).train)
both("earlier_second_leg", "order_id ~T2_osrm_ratio_pred ~guard_adj ~T2_P50", "c_v_t2")(lambda d: earlier(d).predictions)
both("earlier_predictions", "order_id ~T1_P50 ~T2_resid_P50 ~T2_P50 ~T3_base_P50 ~T4_dwell_P50 ~T3_P50 ~ETA_P50 ~t2_ratio_p50 ~t3_ratio_p50 " + PREP, "c_v_eta")(lambda d: earlier(d).predictions)
both("earlier_ratio_sources", "order_id t2_ratio_source t3_ratio_source dwell_source", "c_v_eta")(lambda d: earlier(d).predictions)
register("earlier_leg_diagnostics", _leg_sql("c_v_eta", tuple((leg.removesuffix("_raw"), *rest) for leg, *rest in _LEGS if "corrected" not in leg)))(lambda d: diagnostics.by_leg(earlier(d).predictions, legacy.LEGS))


# the parts of model fitting that give the same on every run
def _t1_levels(d: Delivery) -> DataFrame:
    return ml.level_counts(d.legs.where("t1_actual_min between 0 and 60"), ml.T1_CAT).withColumn("pooled", F.col("n") < ml.t1_spec().min_frequency)


def _t1_modes(d: Delivery) -> DataFrame:
    got = ml.most_frequent(ml.level_counts(d.legs.where("t1_actual_min between 0 and 60"), ml.T1_CAT))
    return d.orders.sparkSession.createDataFrame(sorted(got.items()), "name string, mode string")


register("gbt_t1_levels", O.query("select name, v, n, n < 10 as pooled from c_t1_levels"))(_t1_levels)
register("gbt_t1_modes", O.query("select name, arg_min(v, (-n, v)) as mode from c_t1_levels group by name"))(_t1_modes)
register("gbt_t2b_target", O.query("select order_id, round(t2b_resid, 6) as t2b_resid, row_number() over (order by created_s, order_id) <= floor(count(*) over () * 0.8e0) as is_train from c_t2b_train0"))(lambda d: cols(d.t2b_rows, "order_id t2b_resid is_train"))
register("constant_t1", O.query("select order_id, round(m, 6) as T1_P50 from c_legs cross join (select median(t1_actual_min) as m from c_t1_train) x"))(lambda d: cols(ml.constant(d.legs.where("t1_actual_min between 0 and 60"), "t1_actual_min").predict(d.legs, "T1_P50"), "order_id T1_P50"))


def _gbt_t1(d: Delivery) -> DataFrame:
    return d.fit_t1().predict(d.facts, "T1_P50").select("order_id", "T1_P50")


def _gbt_t2b(d: Delivery) -> DataFrame:
    return d.with_models(d.t1_model, d.fit_t2b()).t2.select("order_id", "T2b_resid_gated")


def _first_tree(d: Delivery) -> DataFrame:
    """Nodes of the first tree of the first leg's model: what splits them, or their median."""
    m = d.fit_t1(1)
    tree, n_num, names = m.model, len(m.spec.num), [*m.spec.num, *m.spec.cat]
    rows = []
    for k in boost.Tree(tree.feature[0], tree.level[0], tree.value[0]).leaves():
        rows.append((k, None, None, None, float(tree.value[0, k])))
    for k in (tree.feature[0] >= 0).nonzero()[0].tolist():
        f = int(tree.feature[0, k])
        level = tree.names[f - n_num][tree.level[0, k]] if f >= n_num else None
        rows.append((k, names[f], None if level else float(tree.limit[0, k]), level, None))
    return d.orders.sparkSession.createDataFrame(rows, "node int, feature string, at_most double, level string, value double")


both("gbt_t1_first_tree", "node feature ~at_most level ~value", "c_f_tree")(_first_tree)
register("gbt_t1")(_gbt_t1)
register("gbt_t2b_resid")(_gbt_t2b)
# the whole estimate with both models; eta_predictions has neither
register("eta_predictions_fitted")(lambda d: order_predictions(d.fit_models().predictions))
register("score_t3_static", O.query("select order_id, round(case when t3_coord_flag = 1 then T3_base_P50 else T3_osrmratio_P50 end, 6) as T3_base_P50, case when t3_coord_flag = 1 then t3_ratio_source_fallback else t3_ratio_source end as source from c_t3_alone"))(lambda d: score_t3(d.orders, d.t3_smoothed, d.t3_baseline, d.p))
