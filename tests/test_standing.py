"""Days merged into a standing table, against all of them at once, and against medians of the rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramo.functions.wstats import weighted_median, with_recency
from tramo.operators.standing import Standing
from tramo.streaming.standing import keep_up

TABLE = Standing(("zone", "hour"), "ratio", "at", 10.0)
SCHEMA = "day int, zone string, hour int, ratio double, at timestamp"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    data = []
    for k in range(1200):
        day = int(rng.integers(0, 6))
        at = start + dt.timedelta(days=4 * day, seconds=int(rng.integers(0, 86400))) if k % 40 else None
        data.append((day, [None, "a", "b"][k % 3], k % 2 if k % 7 else None, float(rng.lognormal()) if k % 50 else None, at))
    data += [(0, "c", 1, 1.5, None), (5, "c", 1, 2.5, None), (3, "d", 1, -2.0, start)]
    return spark.createDataFrame(data, SCHEMA).persist()


def seen(d):
    return {(r.zone, r.hour): (r.v, r.n, r.t) for r in d.collect()}


def near(a, b, by):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1] and (a[k][0] is None) == (b[k][0] is None), k
        assert a[k][0] is None or (a[k][0] == pytest.approx(b[k][0], abs=by) and a[k][2] == pytest.approx(b[k][2], rel=1e-9)), k


def test_merged_days_equal_all_at_once(spark, rows, tmp_path):
    want = seen(TABLE.medians(TABLE.bins(rows)))
    for order, name in ((range(6), "up"), ((5, 0, 3, 1, 4, 2), "late")):
        folder = f"file://{tmp_path}/{name}"
        for k, day in enumerate(order):
            assert TABLE.update(rows.where(F.col("day") == day), folder, k)
        assert not TABLE.update(rows.where("day = 2"), folder, 5)  # sent again
        state, last = TABLE.read(spark, folder)
        assert last == 5
        near(seen(TABLE.medians(state)), want, 1e-9)
    # against the rows themselves: less than a bin apart
    exact = weighted_median(with_recency(rows.where("zone is null or zone <> 'c'"), F.col("at"), 10.0), ["zone", "hour"], "ratio", "w", "v", "n", total="t")
    near({k: v for k, v in want.items() if k[0] != "c"}, seen(exact), TABLE.width)
    assert want["c", 1][0] is None  # rows without a time weigh nothing beside others


def test_no_time_at_all(spark, rows):
    d = rows.withColumn("at", F.lit(None).cast("timestamp"))
    merged = TABLE.merged([TABLE.bins(d.where("day < 3")), TABLE.bins(d.where("day >= 3"))])
    got = seen(TABLE.medians(merged))
    near(got, seen(TABLE.medians(TABLE.bins(d))), 1e-9)
    assert got["c", 1][:2] == (1.5, 2)
    # times that come later make the others weigh nothing
    mixed = TABLE.merged([TABLE.bins(d.where("day < 3")), TABLE.bins(rows.where("day >= 3"))])
    near(seen(TABLE.medians(mixed)), seen(TABLE.medians(TABLE.bins(d.where("day < 3").union(rows.where("day >= 3"))))), 1e-9)


def test_a_stream_keeps_it_up(spark, rows, tmp_path):
    for day in range(6):
        rows.where(F.col("day") == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = keep_up(stream, TABLE, f"file://{tmp_path}/state", f"{tmp_path}/at", availableNow=True)
    query.awaitTermination(240)
    assert query.exception() is None
    state, last = TABLE.read(spark, f"file://{tmp_path}/state")
    assert last >= 2
    near(seen(TABLE.medians(state)), seen(TABLE.medians(TABLE.bins(rows))), 1e-9)
