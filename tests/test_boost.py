"""Trees grown by guesses and sums over all rows, against trees grown in the plainest way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramo.operators import boost, ml
from tramo.operators.ranking import numbered, running_sums

RULE = boost.Rule(depth=3, min_rows=8)


def drawn(seed, n=900):
    rng = np.random.default_rng(seed)
    num = np.array([rng.integers(0, 40, n), rng.integers(0, 3, n)], np.uint8)
    cat = np.array([rng.integers(-1, 6, n), rng.integers(0, 2, n)], np.int32)
    y = np.round(num[0] / 8.0 + 2 * (cat[0] == 3) - cat[1] * num[1] + rng.normal(size=n), 1)  # with many ties
    return boost.Rows(y, np.full(n, float(np.median(y))), num, cat)


def table_of(spark, rows):
    pack = lambda x: [bytearray(r.tobytes()) for r in np.ascontiguousarray(x.T)]
    data = list(zip(rows.y.tolist(), rows.pred.tolist(), pack(rows.num), pack(rows.cat), strict=True))
    return spark.createDataFrame(data, "y double, pred double, num binary, cat binary").repartition(3).persist()


def plain_tree(rows, pred, rule):
    """feature, code by node, and the median of the residuals in each leaf."""
    up, r, split, value = rows.y >= pred, rows.y - pred, {}, {}

    def grow(node, at, depth):
        best = (-1.0, -1, -1)
        if depth < rule.depth and len(at) >= 2 * rule.min_rows and 0 < up[at].sum() < len(at):
            for f in range(len(rows.num) + len(rows.cat)):
                number = f < len(rows.num)
                x = rows.num[f][at].astype(int) if number else rows.cat[f - len(rows.num)][at]
                for code in sorted({*x.tolist()} - {-1} if not number else {*x.tolist()}):
                    side = x <= code if number else x == code
                    n, p = int(side.sum()), int(up[at][side].sum())
                    m, q = len(at) - n, int(up[at].sum()) - p
                    if n >= rule.min_rows and m >= rule.min_rows:
                        d = float(m) * (2 * p - n) - float(n) * (2 * q - m)
                        if d * d / (float(n) * m) > best[0]:
                            best = (d * d / (float(n) * m), f, code)
        if best[0] < 0:
            value[node] = float(np.median(r[at]))
            return
        split[node] = best[1:]
        right = rows.right(best[1], best[2], at)
        grow(2 * node + 1, at[~right], depth + 1)
        grow(2 * node + 2, at[right], depth + 1)

    grow(0, np.arange(len(rows.y)), 0)
    return split, value


def plain(rows, trees, rule):
    pred, out = rows.pred.copy(), []
    for _ in range(trees):
        split, value = plain_tree(rows, pred, rule)
        tree = boost.Tree.empty(rule.depth)
        for k, (f, code) in split.items():
            tree.feature[k], tree.code[k] = f, code
        for k, v in value.items():
            tree.value[k] = v
        out.append((split, value))
        pred = pred + rule.rate * tree.value[rows.leaf(tree)]
    return out, pred


def found(tree):
    return {k: (int(tree.feature[k]), int(tree.code[k])) for k in range(len(tree.feature)) if tree.feature[k] >= 0}, {k: tree.value[k] for k in tree.leaves()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trees_are_those_of_the_plain_way(spark, seed):
    rows = drawn(seed)
    want, pred = plain(rows, 7, RULE)
    table = table_of(spark, rows)
    few = boost.Rows(rows.y[:60], rows.pred[:60], rows.num[:, :60].copy(), rows.cat[:, :60].copy())
    none = boost.Rows(rows.y[:0], rows.pred[:0], rows.num[:, :0].copy(), rows.cat[:, :0].copy())
    for sample, ahead in ((rows, 8), (few, 2), (none, 1)) if seed == 1 else ((rows, 3),):
        got = boost.boost(table, sample, float(rows.pred[0]), len(want), RULE, [6, 2], ahead)
        for (split, value), tree in zip(want, got.trees, strict=True):
            assert found(tree)[0] == split
            assert found(tree)[1] == pytest.approx(value, abs=1e-12)
        # all guesses are right where the sample is the table
        assert got.guesses == len(want) if sample is rows else got.guesses > len(want)
        assert got.jobs <= (3 if ahead == 8 else 8 * len(want))
        made = np.full(len(rows.y), got.start)
        for tree in got.trees:
            made = made + RULE.rate * tree.value[rows.leaf(tree)]
        assert np.abs(rows.y - made).mean() <= np.abs(rows.y - pred).mean() + 1e-12


def test_estimates_are_written_and_go_on(spark, monkeypatch):
    rows = drawn(4, 300)
    monkeypatch.setattr(boost, "WRITE", 2)
    want, _ = plain(rows, 6, RULE)
    got = boost.boost(table_of(spark, rows), rows, float(rows.pred[0]), 6, RULE, [6, 2], 1)
    assert [found(t)[0] for t in got.trees] == [s for s, _ in want]


def test_levels_in_several_pieces_and_tasks(spark, monkeypatch):
    rows = drawn(5, 400)
    monkeypatch.setattr(boost, "PIECE", 2)
    monkeypatch.setattr(boost, "ROWS", 50)
    want, _ = plain(rows, 2, RULE)
    code = boost._Gathered(0, [])
    for k in range(12):
        code._add((0, 0, 0, 0), np.array([1, 3]), np.array([k, 1]), np.array([0, 1]))
    assert [x.tolist() for x in boost.merged(code.parts[0, 0, 0, 0])] == [[1, 3], [66, 12], [0, 12]]
    got = boost.boost(table_of(spark, rows), rows, float(rows.pred[0]), 2, RULE, [6, 2], 2)
    assert [found(t)[0] for t in got.trees] == [s for s, _ in want]


def test_leaves_are_medians_of_their_rows(spark):
    d = spark.range(3000).select((F.rand(3) * 10).alias("x"), F.concat(F.lit("s"), F.col("id") % 7).alias("shop"), F.round(F.rand(4) * 30, 2).alias("y")).persist()
    m = ml.fit(d, ml.Spec(("shop",), ("x",), "y", max_iter=1, max_depth=3, min_rows=30))
    tree = m.model
    rows = d.collect()
    start = float(np.median([r.y for r in rows]))
    assert m.model.start == pytest.approx(start, abs=1e-12)
    leaf = {}
    for r in rows:
        k = 0
        while k < 7 and tree.feature[0, k] >= 0:
            f = tree.feature[0, k]
            k = 2 * k + 1 + int(r.x > tree.limit[0, k] if f == 0 else r.shop == tree.names[0][tree.level[0, k]])
        leaf.setdefault(k, []).append(r.y - start)
    assert len(leaf) > 4 and all(len(v) >= 30 for v in leaf.values())
    assert {k: tree.value[0, k] for k in leaf} == pytest.approx({k: float(np.median(v)) for k, v in leaf.items()}, abs=1e-12)


def test_a_million_levels_are_numbered(spark):
    many = spark.range(1_000_000).select(F.lit("shop").alias("name"), F.format_string("s%07d", "id").alias("v"), (30 + F.col("id") % 3).alias("n"))
    other = spark.createDataFrame([("zone", "b", 40), ("zone", "a", 50), ("zone", "rare", 3), ("zone", "some", 15)], "name string, v string, n long")
    got = ml.level_index(many.unionByName(other), 10, 20)
    assert {(r.v, r.code) for r in got.where("name = 'zone'").collect()} == {("a", 0), ("b", 1), ("rare", 2)}
    shops = got.where("name = 'shop'")
    row = shops.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"), F.max("code").alias("most"), F.count(F.when(F.substring("v", 2, 7).cast("int") != F.col("code"), 1)).alias("odd")).first()
    assert tuple(row) == (1_000_000, 1_000_000, 999_999, 0)


def test_numbers_and_running_sums(spark):
    d = spark.createDataFrame([(k * 37 % 101, k % 3) for k in range(101)], "x long, v long").repartition(4)
    at = numbered(d, ["x"], "at")
    assert [(r.x, r.at) for r in at.orderBy("x").collect()] == [(k, k) for k in range(101)]
    got = running_sums(at, "at", 101, {"s": "v"}).orderBy("at").collect()
    assert [r.s for r in got] == np.cumsum([r.v for r in got]).tolist()
    assert numbered(d.limit(0), ["x"]).count() == 0
