"""Quantiles by bins against Spark's own, and that no plan has the latter."""

import random

import pytest
from pyspark.sql import functions as F

from tramo.functions.wstats import quantiles
from tramo.operators import diagnostics, enrich, smoothing

WANTED = {"a50": ("a", 0.5), "a85": ("a", 0.85), "b25": ("b", 0.25), "b0": ("b", 0.0), "b1": ("b", 1.0)}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles(spark, keys):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, rng.gauss(0, 30), 2.0, 2.01]), rng.choice([None, float(rng.randrange(-3, 4))])) for _ in range(500)]
    rows += [("one", 1.5, None), ("two", 1.0, 4.0), ("two", 9.0, 5.0), ("far", float("inf"), float("nan"))]
    d = spark.createDataFrame(rows, "k string, a double, b double")
    want = d.groupBy(*keys).agg(*[F.percentile(c, q).alias(name) for name, (c, q) in WANTED.items()])
    see = lambda t: sorted([tuple(r[k] if k in keys or r[k] is None else str(round(r[k], 9) + 0.0) for k in [*keys, *WANTED]) for r in t.collect()], key=repr)
    assert see(quantiles(d, keys, WANTED)) == see(want)
    assert [tuple(r) for r in quantiles(d.limit(0), keys, WANTED).collect()] == ([] if keys else [(None,) * len(WANTED)])


def test_no_row_level_median_is_in_one_buffer(spark, capsys):
    d = spark.createDataFrame([], "zone_name_en string, pickup_hr_ksa int, dwell_min double, ETA_actual_min double, ETA_P50 double, order_created_ksa timestamp, t1_actual_min double")
    legs = [("E", "ETA_actual_min", "ETA_P50", "ETA")]
    for plan in (diagnostics.by_leg(d, legs), diagnostics.by_zone_hour(d), *smoothing.dwell(d, 80), enrich.calibrate_t1(d)):
        plan.explain()
        assert not {"median(", "percentile("} & {w for w in ("median(", "percentile(") if w in capsys.readouterr().out}
