"""Every query that has SQL against it, on the smallest tables; tables that several queries use are built once."""

import duckdb
import pytest

from tramo import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(plan):
    """The plans that all queries of this module read, and DuckDB over the same files."""
    early = Q.earlier(plan)
    was = Q.delivery, Q.earlier
    Q.delivery, Q.earlier = (lambda *_: plan), (lambda _: early)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield con
    Q.delivery, Q.earlier = was


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(r[k] for k in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, shared, name):
    want = shared.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert {*Q.QUERIES} <= {*e.queries()} and {*e.oracle_sql()} <= {*e.queries()}


def test_entry_without_what_only_the_operators_need(tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print('eta_predictions' in q, 'op1_mixing' in q, 'pipeline' in q)"
    got = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == ["True", "False", "False"], got.stderr
