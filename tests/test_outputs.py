"""What is written, read and attached: the output set, optional inputs, routes from a table, and a stream that is scored."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tramo import queries as Q
from tramo.functions import exprs as X
from tramo.operators import diagnostics, enrich, ml, priors
from tramo.params import DEFAULT
from tramo.plans import legacy
from tramo.plans.delivery import PREDICTION_COLUMNS, Delivery, with_legs
from tramo.sources import files, fixture, outputs
from tramo.sources.routes import DetourRoutes, TableRoutes
from tramo.streaming.score import score_t3

SF = "/root/testdata/sf0.001"


def test_output_set(spark, plan, tmp_path):
    same = {k: getattr(plan, k) for k in ("t2", "bias_map", "predictions", "held_out")}
    plan = plan.with_models(ml.constant(plan.legs.where("t1_actual_min between 0 and 60"), "t1_actual_min"), None)
    plan.__dict__.update(same)  # the model is the median that those have
    outputs.write_delivery(plan, str(tmp_path))
    outputs.write_enriched(enrich.enrich(plan.orders, DetourRoutes()), str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    for name in ("t2a_ratio_smoothed", "t3_ratio_smoothed", "t3_baseline", "dwell", "t2b_smoothed", "t2_bias_map", "t1_calibration", "t2_calibration", "t3_calibration", "zone_hour_diagnostics", "zone_hour_diagnostics_corrected"):
        assert read(name).count() > 0, name
    assert read("orders_enriched").count() <= 1500 and "ratio_actual_over_osrm_t3" in read("orders_enriched").columns
    assert read("t2b_prior_blend_summary").columns == ["shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow", "n_cell", "parent_value", "prior_p50", "n_prior", "value_blended"]
    assert read("order_level_predictions").columns == list(PREDICTION_COLUMNS) and read("order_level_predictions").count() == 1500
    assert read("ratio_sources").columns == ["order_id", "t2_ratio_source", "t3_ratio_source", "dwell_source"]
    assert {r.leg for r in read("eta_leg_diagnostics").collect()} == {"T1", "T2_raw", "T3", "ETA_raw"}
    all_rows = {r.leg: r.rows for r in read("eta_leg_diagnostics_corrected").collect()}
    late = {r.leg: r.rows for r in read("eta_leg_diagnostics_corrected_holdout").collect()}
    assert {*all_rows} == {*late} == {"T2_corrected", "ETA_corrected"} and all(0 < late[k] < 0.3 * all_rows[k] for k in late)
    errors = [r.MAE for r in sorted(read("zone_hour_diagnostics").collect(), key=lambda r: -r.MAE)]
    assert errors == [r.MAE for r in read("zone_hour_diagnostics").collect()] or read("zone_hour_diagnostics").rdd.getNumPartitions() > 1
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/coverage_report").collect())
    assert text.startswith("T2a coverage: ") and "T2b (shop×hour×dow) direct-cell coverage: " in text and text.endswith("(|bias| >= 0.5 & N>= 12)")
    assert ml.load(f"{tmp_path}/t1_p50", spark).constant == plan.t1_model.constant


def test_coverage_of_absent_columns(spark):
    row = diagnostics.coverage(spark.createDataFrame([(0.7,), (0.1,)], "T2_bias_corr double")).first()
    assert diagnostics.coverage_text(row) == "T2a coverage: n/a\nT2b coverage: n/a\nT2 bias activation rate: 50.0% of orders (|bias| >= 0.5 & N>= 12)\n"


def test_earlier_set(spark, plan, tmp_path, monkeypatch):
    early = replace(Q.earlier(plan), orders=plan.orders.where("order_id % 3 = 0"))
    early = replace(early, t2_model=early.fit_t2(2))
    assert early.t2_model.spec.num == [c for c in ml.T2_LEGACY_NUM]
    outputs.write_earlier(early, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/order_level_predictions")
    assert got.columns == list(legacy.PREDICTION_COLUMNS) and got.select("T2_resid_P50").distinct().count() > 1
    for r in got.where("T2_P50 is not null").collect():
        assert r.T2_P50 == pytest.approx(min(max(r.T2_osrm_ratio_pred + r.T2_resid_P50 + r.guard_adj, 0.5), 240))
    assert spark.read.parquet(f"{tmp_path}/eta_leg_diagnostics").count() == 4 and ml.load(f"{tmp_path}/t2_resid_p50", spark).model is not None


def test_models_share_what_they_do_not_touch(spark, plan, monkeypatch):
    monkeypatch.setattr(Delivery, "fit_t1", lambda self, trees: None)
    monkeypatch.setattr(Delivery, "fit_t2b", lambda self, trees: None)
    _ = plan.t2a_smoothed
    assert plan.fit_models().t2a_smoothed is plan.t2a_smoothed


def test_optional_and_mandatory_files(spark, tmp_path):
    schema = Q.fixture.prep_tables(spark, fixture.deliveries(spark, SF))[1].schema
    assert files.read_optional(spark, None, schema).count() == 0
    (tmp_path / "shop.csv").write_text("shop_id,prep_time_sec\n1,60\n2,x\n")
    assert files.read_optional(spark, f"{tmp_path}/shop.csv", schema).count() == 2
    (tmp_path / "cal.csv").write_text(" zone_name_en ,ratio_p50,n\nZ1,1.5,3\n")
    need = ["zone_name_en", "ratio_p50", "n"]
    assert files.read_required(spark, f"{tmp_path}/cal.csv", need).columns == need
    with pytest.raises(ValueError, match="pickup_hr_ksa"):
        files.read_required(spark, f"{tmp_path}/cal.csv", [*need, "pickup_hr_ksa"])
    with pytest.raises(FileNotFoundError, match="absent"):
        files.read_required(spark, f"{tmp_path}/absent.csv", need)


def test_routes_of_a_table_and_infinite_ratios(spark, plan):
    d = enrich.keyed(enrich.legs(plan.orders)).limit(40)
    pairs = enrich.distinct_pairs(d)
    table = DetourRoutes().routes(pairs).where("pair_key is not null")
    one = table.orderBy("pair_key").first()["pair_key"]
    table = table.withColumn("sec", F.when(F.col("pair_key") == one, 0.0).otherwise(F.col("sec"))).where("meters % 7 < 6")
    got = enrich.attach_routes(d, TableRoutes(table), keep_infinite=True)
    assert got.count() == 40
    zero = got.where((F.col("t3_pair_key") == one) & (F.col("t3_actual_min") > 0)).select("ratio_actual_over_osrm_t3").union(got.where((F.col("t2_pair_key") == one) & (F.col("t2_actual_min") > 0)).select("ratio_actual_over_osrm_t2"))
    assert all(r[0] == float("inf") for r in zero.collect())
    assert enrich.attach_routes(d, TableRoutes(table.limit(0))).where("t2_osrm_duration_min is not null").count() == 0


def test_hours_of_the_zone(spark, plan):
    at = lambda zone: {r.order_id: r.pickup_hr_ksa for r in with_legs(plan.orders, replace(DEFAULT, hour_zone=zone)).select("order_id", "pickup_hr_ksa").collect()}
    riyadh, utc = at("Asia/Riyadh"), at("UTC")
    assert all(riyadh[k] is None or riyadh[k] == (utc[k] + 3) % 24 for k in riyadh)


def test_preparation_minutes_from_times(spark):
    d = spark.sql("select 1 as mbo_chain_id, 'v' as sub_vertical_detail, timestamp'2024-01-01 10:00:00' as accepted_at, timestamp'2024-01-01 10:12:30' as picked_up_at union all select 2, 'v', timestamp'2024-01-01 10:00:00', null")
    got = priors.from_orders(d).collect()
    assert [(r.shop_id, r.prep_time_min, r.pickup_hr_ksa, r.dow) for r in got] == [(1, 12.5, 13, 0)]


def test_second_leg(spark):
    d = spark.createDataFrame([(10.0, 2.0, 1.0), (0.1, -5.0, 0.0), (None, 1.0, 0.0), (300.0, 0.0, 0.0)], "T2_osrm_ratio_pred double, T2_resid_P50 double, guard_adj double")
    assert [r.T2_P50 for r in legacy.second_leg(d).collect()] == [13.0, 0.5, None, 240.0]


def test_stream_equals_table(spark, plan, tmp_path):
    plan.orders.repartition(4).write.parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in score_t3(plan.orders, plan.t3_smoothed, plan.t3_baseline).collect()}
    orders = spark.readStream.schema(plan.orders.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    assert orders.isStreaming
    query = score_t3(orders, plan.t3_smoothed, plan.t3_baseline).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and len(query.recentProgress) >= 2
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_guard_of_worst_zones(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 2.0), ("a", 1, -1.0), ("b", 1, 2.0), (None, 1, 2.0)], "z string, p int, g double")
    assert [r[0] for r in d.select(X.peak_guard(F.col("z"), F.col("p"), F.col("g"), ["a"])).collect()] == [1.4, 0.0, 0.0, 0.0, 0.0]
