"""Fitting on a small table: pooled and unseen levels, missing values, absent columns, few rows, and saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramo.operators import ml

SPEC = ml.Spec(("zone", "shop", "gone"), ("km", "hour", "never"), "y", max_iter=12, max_depth=3, min_rows=5, min_frequency=10)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        zone = ["a", "b", "c"][i % 3] if i % 50 else None
        shop = int(i % 5) if i % 60 else 1000 + i  # shops from 1000 on have one row each
        km = float(rng.uniform(0, 10)) if i % 40 else None
        y = 3.0 + (km or 5.0) * {"a": 1.0, "b": 2.0}.get(zone, 0.5) + float(rng.normal())
        rows.append((i, zone, shop, km, int(i % 24), None, y if i % 100 else None))
    return spark.createDataFrame(rows, "id long, zone string, shop int, km double, hour int, never double, y double")


@pytest.fixture(scope="module")
def fitted(table):
    return ml.fit(table, SPEC)


def test_levels_and_modes(table, fitted):
    got = {(r["name"], r["v"]): r["n"] for r in ml.level_counts(table.where("y is not null"), ["zone", "shop"]).collect()}
    assert got["zone", "a"] == table.where("zone = 'a' and y is not null").count() and ("zone", None) not in got
    assert ml.most_frequent(ml.level_counts(table.limit(0), ["zone"])) == {}
    best = max(("a", "b", "c"), key=lambda z: (got["zone", z], -ord(z)))
    assert fitted.modes["zone"] == best
    # rare levels are pooled; columns without any value or that don't exist aren't features
    assert list(fitted.pooled) == ["shop"] and {int(r["v"]) for r in fitted.rare.collect()} == {1000 + i for i in range(0, 600, 60) if i % 100}
    assert list(fitted.spec.cat) == ["zone", "shop"] and list(fitted.spec.num) == ["km", "hour"]


def test_prepared_values(spark, fitted):
    rare = int(fitted.rare.first()["v"])
    d = spark.createDataFrame([(1, None, rare, 2.0), (2, "a", 77, None), (3, "zz", 1, 1.0)], "id long, zone string, shop int, km double")
    got = {r.id: r for r in fitted.prepared(d).collect()}
    assert (got[1]["_c_zone"], got[1]["_c_shop"]) == (fitted.modes["zone"], ml.RARE)
    assert (got[2]["_c_shop"], got[3]["_c_zone"]) == ("77", "zz")
    assert (got[2]["_n_km"], got[1]["_n_hour"]) == (fitted.medians["km"], fitted.medians["hour"])
    assert fitted.predict(d, "p").columns == [*d.columns, "p"] and fitted.predict(d, "p").where("p is not null").count() == 3


def test_better_than_the_constant(table, fitted):
    d = table.where("y is not null")
    one = ml.constant(d, "y")
    assert one.constant == pytest.approx(d.agg(F.median("y")).first()[0])
    err = lambda m: m.predict(d, "p").agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]
    assert err(fitted) < 0.6 * err(one)


def test_few_rows_and_none(spark, table):
    few = ml.fit(table, SPEC, 10_000)
    assert few.model is None and few.constant == pytest.approx(table.agg(F.median("y")).first()[0])
    assert ml.fit(table.limit(0), SPEC).constant == 5.0
    assert {r.p for r in few.predict(table, "p").select("p").collect()} == {few.constant}


def test_saved_models_predict_the_same(spark, table, fitted, tmp_path):
    for k, model in enumerate((fitted, ml.constant(table, "y", SPEC))):
        for _ in range(2):  # the second one replaces the first
            model.save(f"{tmp_path}/m{k}", spark)
        again = ml.load(f"{tmp_path}/m{k}", spark)
        see = lambda m: [round(r.p, 9) for r in m.predict(table, "p").orderBy("id").collect()]  # noqa: B023, E731
        assert see(again) == see(model) and again.modes == model.modes


def test_specs_have_the_published_features():
    t1, t2b, old = ml.t1_spec(), ml.t2b_spec(), ml.t2_legacy_spec()
    assert (t1.min_frequency, t1.max_iter, t1.min_rows, t2b.min_frequency, t2b.max_iter, t2b.min_rows, old.min_frequency, old.max_iter, old.min_rows) == (10, 600, 20, 15, 500, 25, 20, 600, 25)
    assert "dow" in old.num and len(old.num) == 13
    assert "t2a_actual_min" not in t2b.num and "t2a_actual_min" in ml.t2b_spec(leaky=True).num
