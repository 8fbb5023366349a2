"""The earlier model's tables from routed orders that are made once."""

from tramo import queries as Q
from tramo.operators import enrich
from tramo.plans import legacy
from tramo.sources.routes import DetourRoutes


def test_medians_of_both_legs_are_those_of_the_calibration(spark, plan):
    seen, kept = enrich.enrich(plan.orders, DetourRoutes()), []

    def keep(df, name):
        kept.append(name)
        return df.persist()

    for leg, got in zip(("t2", "t3"), enrich.ratio_medians(seen, keep), strict=True):
        want = enrich.calibrate_ratios(seen, leg).select(*got.columns)
        assert got.dtypes == want.dtypes and got.count() > 0
        key = lambda df: {(r.pickup_hr_ksa, r.zone_name_en, r.dist_bin): (round(r.ratio_p50, 9), r.n) for r in df.collect()}
        assert key(got) == key(want)
    assert kept.count("routed") == 1


def test_routes_and_legs_are_made_once(spark, plan, monkeypatch):
    made, kept = [], []
    monkeypatch.setattr(Q, "stage", lambda df, name, was=Q.stage: kept.append(name) or was(df, name))
    e = Q.earlier(plan)
    monkeypatch.setattr(legacy, "with_legs", lambda *a, was=legacy.with_legs: made.append(1) or was(*a))
    # calibration tables read what was written: no route is attached again
    for table in (e.calib_t2, e.calib_t3):
        assert "pair_key" not in table._jdf.queryExecution().analyzed().toString()
    assert kept.count("routed") == 1 and kept.count("prep") == 1
    e.features
    assert len(made) == 1 and {"legs", "prep_rows", "prep_stats", "features"} <= {*kept}
    assert e.features.count() == plan.orders.count()
