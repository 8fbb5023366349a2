"""A router that counts its requests: each pair is asked for once, over all actions, runs and killed tasks."""

import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tramo.operators import enrich
from tramo.sources import outputs
from tramo.sources.route_store import StoredRoutes
from tramo.sources.routes import HttpRoutes, Session


@pytest.fixture(scope="module")
def router():
    """Its address, what it was asked, and how many requests were under way at most."""
    asked, lock, now = Counter(), threading.Lock(), [0, 0]

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            with lock:
                asked[self.path] += 1
                now[0] += 1
                now[1] = max(now)
            lon1, lat1 = map(float, self.path.split("/")[-1].split(";")[0].split(","))
            ok = {"code": "Ok", "routes": [{"duration": lon1 * 10, "distance": lat1 * 100}]} if lat1 != 24.0 else {"code": "NoRoute"}
            body = b"{" if lat1 == 13.0 else json.dumps(ok).encode()  # one that can't be read
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            with lock:
                now[0] -= 1

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, now
    server.shutdown()


def pairs_of(spark, lats):
    return spark.createDataFrame([(f"k{x}", float(x), 46.5, float(x) + 1, 47.0) for x in lats], "pair_key string, lat1 double, lon1 double, lat2 double, lon2 double")


def test_each_pair_once(spark, router, tmp_path):
    base, asked, now = router
    asked.clear()
    store = StoredRoutes(f"file://{tmp_path}/s", HttpRoutes(base, workers=2, pause=0), threads=3, flush=4)
    pairs = pairs_of(spark, range(14, 44)).union(pairs_of(spark, range(20, 23)))
    got = store.routes(pairs)
    for _ in range(2):  # as often as is read
        rows = {r.pair_key: (r.sec, r.meters) for r in got.collect()}
    assert rows == {f"k{x}": (465.0, x * 100.0) if x != 24 else (None, None) for x in range(14, 44)}
    assert len(asked) == 30 and set(asked.values()) == {1} and now[1] <= 2 * 3
    # another run, with some pairs more
    assert StoredRoutes(store.folder, store.router).routes(pairs_of(spark, range(30, 50))).where("sec is not null").count() == 20
    assert len(asked) == 36 and set(asked.values()) == {1}
    assert store.fill(pairs) == 0 and not (tmp_path / "s" / "log").exists()
    assert store.stored(spark).groupBy("status").count().orderBy("status").collect() == [("none", 1), ("route", 35)]


class Dying:
    """A session whose process ends before its last request, once."""

    def __init__(self, mark, after):
        self.mark, self.after, self.session = mark, after, Session()

    def __call__(self, url):
        self.after -= 1
        if self.after < 0 and not os.path.exists(self.mark):
            open(self.mark, "w").close()
            os._exit(1)
        return self.session(url)


def test_a_killed_task_asks_only_for_what_is_left(spark, router, tmp_path):
    base, asked, _ = router
    asked.clear()
    mark = f"{tmp_path}/killed"
    store = StoredRoutes(f"file://{tmp_path}/s", HttpRoutes(base, workers=1, pause=0, session=lambda: Dying(mark, 9)), threads=1, flush=1)
    pairs = pairs_of(spark, range(50, 70))
    with pytest.raises(Exception, match=".*"):  # this session's tasks are tried once
        store.fill(pairs)
    assert len(asked) == 9 and store.stored(spark).count() == 9
    # a log that was written within a run is read by the task that is tried again
    assert store.fill(pairs) == 11
    assert len(asked) == 20 and set(asked.values()) == {1} and store.stored(spark).count() == 20


def test_a_task_reads_its_own_log(spark, router, tmp_path):
    base, asked, _ = router
    asked.clear()
    store = StoredRoutes(f"file://{tmp_path}/s", HttpRoutes(base, workers=1, pause=0), flush=2)
    dealt = pairs_of(spark, range(70, 80)).withColumn("bucket", F.lit(0)).coalesce(1)
    assert [dealt.mapInArrow(store._asked(), "n long").first()[0] for _ in range(2)] == [10, 0]
    assert len(asked) == 10 and set(asked.values()) == {1}


def test_what_failed_is_asked_again_on_demand(spark, router, tmp_path):
    base, asked, _ = router
    asked.clear()
    store = StoredRoutes(f"file://{tmp_path}/s", HttpRoutes(base, workers=1, retries=1, pause=0))
    pairs = pairs_of(spark, [13, 80])
    assert store.fill(pairs) == 2 and sum(asked.values()) == 3
    assert store.fill(pairs) == 0 and sum(asked.values()) == 3
    assert StoredRoutes(store.folder, store.router, retry=True).fill(pairs) == 1 and sum(asked.values()) == 5
    assert {(r.pair_key, r.status) for r in store.stored(spark).collect()} == {("k13", "failed"), ("k80", "route")}


def test_writing_enriched_orders_asks_nothing(spark, router, plan, tmp_path):
    base, asked, _ = router
    asked.clear()
    orders = plan.orders.where("order_id % 9 = 0")
    df = enrich.enrich(orders, StoredRoutes(f"file://{tmp_path}/s", HttpRoutes(base, workers=2, pause=0)))
    n = len(asked)
    assert n == enrich.distinct_pairs(enrich.keyed(enrich.legs(orders))).count() and set(asked.values()) == {1}
    outputs.write_enriched(df, f"{tmp_path}/out")
    assert sum(asked.values()) == n and spark.read.parquet(f"{tmp_path}/out/orders_enriched").where("t3_osrm_duration_min is not null").count() > 0
