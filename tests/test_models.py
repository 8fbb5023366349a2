"""The boosted queries and the estimate that joins their models."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tramo import queries as Q
from tramo.operators import ml
from tramo.plans.delivery import Delivery

SF = "/root/testdata/sf0.001"


@pytest.fixture
def fits(monkeypatch):
    """What ml.fit is asked for; no model is fitted."""
    seen = []

    def fit(df, spec, least_rows=0):
        seen.append((spec, df.count()))
        return ml.Fitted(spec, None, None, (), {}, 7.0)

    monkeypatch.setattr(ml, "fit", fit)
    return seen


def test_boosted_queries_have_all_trees(spark, fits):
    d = Delivery(None)
    d.__dict__["legs"] = spark.createDataFrame([(1, 5.0), (2, 70.0)], "order_id long, t1_actual_min double")
    assert {r.T1_P50 for r in Q._gbt_t1(d).collect()} == {7.0}
    assert [(s.max_iter, n) for s, n in fits] == [(600, 1)]


def test_residual_gate_counts_rows_before_the_split(spark, fits):
    d = Delivery(None)
    d.__dict__["t2"] = spark.range(1100).select(F.col("id").alias("order_id"), F.timestamp_seconds("id").alias("order_created_ksa"), F.lit(9.0).alias("t2b_actual_min"), F.lit(4.0).alias("T2b_base_P50"))
    assert d.fit_t2b().constant == 7.0 and [(s.max_iter, n) for s, n in fits] == [(500, 880)]
    d.__dict__["t2"] = d.t2.limit(999)
    assert d.fit_t2b() is None and len(fits) == 1


def test_residual_is_0_where_rows_are_few(plan, fits):
    d = replace(plan, p=replace(plan.p, min_train_resid=10_000))
    d.__dict__["t2"] = plan.t2
    d.__dict__["t2a"], d.__dict__["t2b_blend"] = plan.t2a, plan.t2b_blend
    assert {r.T2b_resid_gated for r in Q._gbt_t2b(d).collect()} == {0.0} and not fits


def test_fitted_estimate_uses_both_models(spark, plan, monkeypatch):
    monkeypatch.setattr(Q, "delivery", lambda *_: plan)
    t1, t2b = ml.t1_spec, ml.t2b_spec
    asked = []
    monkeypatch.setattr(ml, "t1_spec", lambda trees: asked.append(trees) or t1(2))
    monkeypatch.setattr(ml, "t2b_spec", lambda leaky, trees: asked.append(trees) or t2b(leaky, 2))
    got = Q.QUERIES["eta_predictions_fitted"](spark, SF).collect()
    assert asked == [600, 500] and len(got) == 1500
    assert len({r.T1_P50 for r in got}) > 1 and len({r.T2b_resid_gated for r in got}) > 1
    for r in got:
        assert r.T2b_base_P50 is None or r.T2b_P50 == pytest.approx(min(max(r.T2b_base_P50 + r.T2b_resid_gated, 0), 90), abs=1e-5)
        assert r.ETA_P50 is None or r.ETA_P50 == pytest.approx(r.T1_P50 + r.T2_P50 + r.T3_P50, abs=1e-5)
