"""Order files with line breaks in quoted fields, short and long rows, from many tasks; against pandas over the same file."""

import io

import numpy as np
import pandas as pd
import pytest

from tramo.sources import files, records

HEAD = "order_id, zone ,note,km\n"
SOME = (
    HEAD + '1,Z1,"a, b",2.5\n2,Z2,"two\nlines, and ""quotes""",3\n3,Z3\n4,Z4,x,1,extra\n\n   \n5,"Z\n\n5",NA,\n6,5" pipe,a"b,7\n7,"ab"cd,"",null\n'
    '8,Z8,"open, ""still""\nmore\n\neven more",9\n9,Z9,"",,\n10,é石,"""","\n"\n'
)


@pytest.fixture
def small_blocks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(size):
        for k in was:
            spark.conf.set(k, str(size))

    yield put
    for k, v in was.items():
        spark.conf.set(k, v)


def by_pandas(text):
    d = pd.read_csv(io.StringIO(text), on_bad_lines="skip", dtype=str)
    d.columns = [c.strip() for c in d.columns]
    return sorted(tuple(None if pd.isna(v) else v for v in r) for r in d.itertuples(index=False))


def ours(read):
    return sorted((tuple(r) for r in read.rows.collect()), key=lambda r: tuple((v is not None, v or "") for v in r))


def same(read, text):
    want = sorted(by_pandas(text), key=lambda r: tuple((v is not None, v or "") for v in r))
    assert ours(read) == want


@pytest.mark.parametrize("size", [25, 10_000])
def test_all_cases_in_any_blocks(spark, small_blocks, tmp_path, size):
    (tmp_path / "a.csv").write_text(SOME)
    small_blocks(size)
    got = records.read(spark, f"{tmp_path}/a.csv")
    assert got.rows.columns == ["order_id", "zone", "note", "km"]
    same(got, SOME)
    assert sorted((r.text, r.n_fields) for r in got.dropped.collect()) == [("4,Z4,x,1,extra", 5), ('9,Z9,"",,', 5)]
    if size < 100:
        assert records._lines(spark, f"{tmp_path}/a.csv").rdd.getNumPartitions() > 4


def test_drawn_files(spark, small_blocks, tmp_path):
    rng = np.random.default_rng(5)
    parts = ["a", "", "x y", '"q"', '"a,b"', '"l1\nl2"', '"d""q"', '"\n\n"', 'm"id', '"t"ail', "NA", "1.5", '"""\n"']
    text = HEAD
    for k in range(80):
        text += ",".join([str(k), *[str(rng.choice(parts)) for _ in range(int(rng.integers(1, 5)))]]) + str(rng.choice(["\n", "\n", "\n\n"]))
    (tmp_path / "b.csv").write_text(text)
    small_blocks(150)
    same(records.read(spark, f"{tmp_path}/b.csv"), text)
    (tmp_path / "c.csv").write_bytes(SOME.replace("\n", "\r\n").encode())
    got = records.read(spark, f"{tmp_path}/c.csv")
    assert len(got.rows.collect()) == len(by_pandas(SOME)) and {r.order_id for r in got.rows.collect()} == {r[0] for r in by_pandas(SOME)}


def test_several_files_one_open_and_an_empty_table(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("﻿" + HEAD + '1,"a\nb",,\n')
    (tmp_path / "d" / "2.csv").write_text(HEAD + '2,b,c,d\n3,"never closed\n4,x\n')
    got = ours(records.read(spark, f"{tmp_path}/d"))
    assert got == [("1", "a\nb", None, None), ("2", "b", "c", "d"), ("3", "never closed\n4,x\n", None, None)] or got == [("1", "a\nb", None, None), ("2", "b", "c", "d"), ("3", "never closed\n4,x", None, None)]
    (tmp_path / "e.csv").write_text(HEAD)
    assert records.read(spark, f"{tmp_path}/e.csv").rows.count() == 0
    (tmp_path / "f.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        records.read(spark, f"{tmp_path}/f.csv")


def test_orders_come_through_it(spark, small_blocks, tmp_path):
    text = "order_id, order_created_ksa,zone_name_en,osrm_distance_km\n1,2024-01-01 10:00:00,\"Z\n1\",2.5\n2,bad,Z2\n3,2024-01-02 00:00:00+03:00,Z3,x,y\n"
    (tmp_path / "o.csv").write_text(text)
    small_blocks(80)
    got = sorted(files.normalise_orders(files.read_csv(spark, f"{tmp_path}/o.csv")).collect(), key=lambda r: r.order_id)
    assert [(r.order_id, r.zone_name_en, r.t3_osrm_distance_km, r.order_created_ksa is None) for r in got] == [("1", "Z\n1", 2.5, False), ("2", "Z2", None, True)]
    typed = files.read_csv(spark, f"{tmp_path}/o.csv", "order_id long, order_created_ksa string, zone_name_en string, osrm_distance_km double")
    assert sorted(r.order_id for r in typed.collect()) == [1, 2]
    # fewer columns read don't change which rows there are
    assert files.read_csv(spark, f"{tmp_path}/o.csv").select("order_id").count() == 2
