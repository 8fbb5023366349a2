"""Trees of a table that one task can hold: the plain ones, and nothing is asked of other tasks."""

import numpy as np
import pytest

from tramo import tables
from tramo.operators import boost, ml

from .test_boost import RULE, drawn, found, plain, table_of


def test_one_task_grows_the_plain_trees(spark):
    rows = drawn(6)
    want, _ = plain(rows, 7, RULE)
    got = boost.grown(table_of(spark, rows), float(rows.pred[0]), len(want), RULE)
    for (split, value), tree in zip(want, got.trees, strict=True):
        assert found(tree)[0] == split and found(tree)[1] == pytest.approx(value, abs=1e-12)


def test_a_table_larger_than_the_bins_sample_asks_for_nothing(spark, monkeypatch):
    monkeypatch.setattr(boost, "SAMPLE", 200)
    monkeypatch.setattr(boost, "_ask", lambda *_: pytest.fail("a job for parts of a tree"))
    rng = np.random.default_rng(7)
    data = [(float(x), "abc"[k % 3], float(np.round(x + 3 * (k % 3) + e, 2))) for k, (x, e) in enumerate(zip(rng.uniform(0, 10, 2000), rng.normal(size=2000), strict=True))]
    m = ml.fit(spark.createDataFrame(data, "x double, shop string, y double"), ml.Spec(("shop",), ("x",), "y", max_iter=40, max_depth=3))
    assert len(m.model.feature) == 40


def test_settled_nodes_are_not_summed_up_again():
    rows = drawn(8, 300)
    out, up = boost._Gathered(2, [6, 2], RULE.depth), rows.y >= rows.pred
    tree = boost.guess(rows, rows.pred, RULE, {})
    node = rows.root(7)
    rows.move(tree, node, 0, 0)
    out.level(0, rows, node, up, 1, {0: (0, 0), 1: (0, 0)})
    assert {k for _, k in out.totals} == {2} and out.totals[0, 2].tolist() == [int((node == 2).sum()), int(up[node == 2].sum())]


def test_staged_plans_leave_the_session_as_it_was(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with tables.compiled(spark):
        assert spark.conf.get(key) == "8000"
    assert tables.stage(spark.range(3), "three").count() == 3 and spark.conf.get(key) == before
