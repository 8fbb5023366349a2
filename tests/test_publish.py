"""Sets of output tables that appear whole, or not at all; and evaluation on orders that no table saw."""

import pytest

from tramo.plans.delivery import TABLES, Delivery
from tramo.sources import outputs


def test_a_run_that_ends_half_way_changes_nothing(spark, tmp_path):
    top = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        outputs.published(spark, top)

    def write(n, fail=False):
        def run(folder):
            outputs.write_table(spark.range(n), f"{folder}/a")
            if fail:
                raise RuntimeError("ended")
            outputs.write_table(spark.range(n), f"{folder}/b")

        return run

    first = outputs.publish(spark, top, write(3))
    assert outputs.published(spark, top) == first
    with pytest.raises(RuntimeError):
        outputs.publish(spark, top, write(5, fail=True))
    now = outputs.published(spark, top)
    assert now == first and [spark.read.parquet(f"{now}/{t}").count() for t in "ab"] == [3, 3]
    second, third = outputs.publish(spark, top, write(7)), outputs.publish(spark, top, write(9))
    assert outputs.published(spark, top) == third and spark.read.parquet(f"{second}/b").count() == 7
    outputs.prune(spark, top, 2)
    assert sorted(p.name for p in (tmp_path / "out" / "sets").iterdir()) == sorted(x.rpartition("/")[2] for x in (second, third))
    outputs.prune(spark, top, 1)
    assert outputs.published(spark, top) == third and len([*(tmp_path / "out" / "sets").iterdir()]) == 1


def test_unseen_orders_meet_tables_of_earlier_ones(spark, plan):
    d = Delivery(plan.orders, plan.p, keep=plan.keep)
    late = d.unseen(0.8)
    times = {r.order_id: r.order_created_ksa for r in plan.orders.select("order_id", "order_created_ksa").collect()}
    ids = {r.order_id for r in late.orders.select("order_id").collect()}
    assert len(ids) == 300 and min(times[i] for i in ids) >= max(t for i, t in times.items() if i not in ids)
    assert late.t2a_cells.agg({"n": "sum"}).first()[0] < plan.t2a_cells.agg({"n": "sum"}).first()[0] and set(TABLES) <= set(late.__dict__)
    window = d.unseen(0.6, 0.8).orders.select("order_id").collect()
    assert len(window) == 300 and not {r.order_id for r in window} & ids
