"""Literal cases of column functions and weighted medians."""

import pytest
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import recency_weight, weighted_median
from tramo.operators import smoothing
from tramo.operators.split import temporal_split
from tramo.sources import files
from tramo.sources.routes import HttpRoutes, parse_route


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_distance_labels(spark):
    km = [(0.0,), (0.999,), (1.0,), (19.99,), (20.0,), (-1.0,), (1e9,), (None,)]
    assert values(spark, km, "km double", X.dist_label(F.col("km"))) == ["<1", "<1", "1-2", "12-20", "20+", "20+", "20+", None]
    assert values(spark, km, "km double", X.dist_cut(F.col("km"))) == ["<1", "<1", "1-2", "12-20", "20+", None, None, None]


def test_limits(spark):
    r = [(-9.0,), (-6.0,), (0.3,), (12.0,), (None,), (float("nan"),)]
    assert values(spark, r, "r double", X.gate_resid(F.col("r"))) == [-6.0, -6.0, 0.3, 10.0, 0.0, 0.0]
    assert values(spark, [(13,), (14,), (22,), (23,), (None,)], "h int", X.is_peak(F.col("h"))) == [0, 1, 1, 0, 0]
    assert values(spark, [("2",), ("0.5",), ("x",), (None,), ("NaN",)], "s string", X.stacking_bucket(F.col("s"))) == [1, 0, 0, 0, 0]
    assert values(spark, [(None,)], "x double", X.clip(F.col("x"), 0.0, 1.0)) == [None]


def test_times(spark):
    got = values(spark, [("2024-01-01 10:00:00",), ("2024-01-01 10:00:00+00:00",), ("no",), (None,)], "s string", X.parse_ksa(F.col("s")).cast("string"))
    assert got == ["2024-01-01 07:00:00", "2024-01-01 10:00:00", None, None]
    got = values(spark, [("2024-01-01 10:00:00+03:00",), ("2024-01-01 10:00:00",)], "s string", X.as_time(F.col("s")).cast("string"))
    assert got == ["2024-01-01 07:00:00", "2024-01-01 10:00:00"]


@pytest.mark.parametrize(("n", "cell", "want"), [(5, 2.5, 1.8538), (50, 2.5, 2.1182), (200, 2.5, 2.3385)])
def test_shrink(spark, n, cell, want):
    assert values(spark, [(n, cell)], "n long, c double", X.shrink(F.col("n"), F.col("c"), 60, F.lit(1.8)))[0] == pytest.approx(want, abs=1e-4)


def test_recency(spark):
    ref = F.lit("2024-03-01").cast("timestamp")
    rows = [("2024-03-01",), ("2024-02-09",), ("2024-01-19",), (None,)]
    assert values(spark, rows, "d string", recency_weight(F.col("d").cast("timestamp"), ref, 21.0)) == pytest.approx([1, 0.5, 0.25, 0])


COORD = "a double, b double, c double, d double, km double, hv double"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((0.0, 0.0, 24.0, 46.0, 5.0, 5.0), "zero_coords"),
        ((0.0, 0.0, 60.0, 46.0, None, 5.0), "zero_coords"),
        ((46.0, 24.0, 24.0, 46.0, 5.0, 5.0), "out_of_bbox"),
        ((None, 46.0, 24.0, 46.0, 5.0, None), "out_of_bbox"),
        ((24.0, 46.0, 24.0, 46.0, None, 5.0), "osrm_dist_missing"),
        ((24.0, 46.0, 24.0, 46.0, -1.0, 5.0), "osrm_dist_missing"),
        ((24.0, 46.0, 24.0, 46.0, 0.05, 1.0), "osrm_zero_vs_haversine"),
        ((24.0, 46.0, 24.0, 46.0, 1.0, 3.0), "hav/osrm_too_high"),
        ((24.0, 46.0, 24.0, 46.0, 9.0, 2.0), "hav/osrm_too_low"),
        ((24.0, 46.0, 24.0, 46.0, 1.0, 1.9), ""),
    ],
)
def test_coord_reason(spark, row, reason):
    assert values(spark, [row], COORD, X.coord_reason(*[F.col(c) for c in ("a", "b", "c", "d", "km", "hv")])) == [reason]


def test_weighted_median(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 2.0), (None, 5.0, 1.0), ("b", None, 1.0), ("z", 7.0, 0.0), ("t", 4.0, 1.0), ("t", 4.0, 1.0), ("t", 4.01, 3.0)]
    d = spark.createDataFrame(rows, "k string, v double, w double")
    assert {r.k: (r.m, r.n) for r in weighted_median(d, ["k"], "v", "w", "m", "n").collect()} == {"a": (2.0, 3), None: (5.0, 1), "z": (7.0, 1), "t": (4.01, 3)}
    assert weighted_median(d.where("k = 'a'"), [], "v", "w", "m", "n").first() == (2.0, 3)


@pytest.mark.parametrize(("mode", "want"), [("balanced", (10 * 2 + 30 * 2) / 40), ("reference", (10 * 2 + 30 * 2 + 80 * 2) / 40)])
def test_missing_prior(spark, mode, want):
    cells = spark.createDataFrame([("Z", 10, "<1", 2.0, 10)], "zone_name_en string, pickup_hr_ksa int, dist_bin string, ratio_p50 double, n long")
    assert smoothing.smooth_ratios(cells, 30, None, 80, mode).first()["ratio_smoothed"] == pytest.approx(want)
    with pytest.raises(ValueError):
        smoothing.smooth_ratios(cells.drop("n"), 30)


def test_temporal_split(spark):
    d = spark.createDataFrame([(k, None if k == 3 else f"2024-01-0{1 + k % 4}") for k in range(11)], "id long, s string").withColumn("ts", F.col("s").cast("timestamp"))
    got = {r.id for r in temporal_split(d, "ts", "id", 0.8).where("is_train").collect()}
    assert len(got) == 8 and got == {0, 1, 2, 4, 5, 6, 8, 9}
    assert temporal_split(d.limit(0), "ts", "id", 0.8).count() == 0


def test_routes(spark):
    assert parse_route('{"code": "Ok", "routes": [{"duration": 60, "distance": 900}]}') == (60, 900)
    assert parse_route('{"code": "NoRoute"}') == (None, None)
    pairs = spark.createDataFrame([("k", 1.0, 2.0, 3.0, 4.0)], "pair_key string, lat1 double, lon1 double, lat2 double, lon2 double")

    def answer(url):
        return '{"code": "Ok", "routes": [{"duration": 60, "distance": 900}]}' if "2.0,1.0;4.0,3.0" in url else "{"

    assert HttpRoutes("http://x", workers=1, pause=0, session=lambda: answer).routes(pairs).first() == ("k", 60.0, 900.0)


def test_orders_from_text(spark, tmp_path):
    (tmp_path / "o.csv").write_text(" order_created_ksa ,osrm_distance_km,pickup_hr_ksa\n2024-01-01 10:00:00,2.5,7\n2024-01-01 10:00:00,x,\n")
    got = files.normalise_orders(files.read_csv(spark, str(tmp_path))).collect()
    assert [(str(r.order_created_ksa), r.t3_osrm_distance_km, r.pickup_hr_ksa, r.zone_name_en, r.shop_id) for r in got] == [("2024-01-01 07:00:00", 2.5, "7", "UNKNOWN", -1), ("2024-01-01 07:00:00", None, None, "UNKNOWN", -1)]
