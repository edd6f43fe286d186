"""Every query with SQL gives that SQL's rows, and what is registered can be called."""

import os

import pytest

import __spark_entry__ as entry
from segtable import queries as tables
from segtable.engine import Engine
from segtable.operators.writing import insert
from segtable.options import TableOptions

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = [n for n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_staged_union_and_delete_over_all_keys(spark):
    """What scan_staged_union and scan_after_delete do, without the ranges of keys in their SELECTs."""
    rows = tables.parquet(spark, SF, "events")
    e = Engine(spark)
    table = e.attach("events", tables.build(spark, rows.where("event_id % 2 = 0"), TableOptions()))
    insert(table, rows.where("event_id % 2 != 0"))
    columns = ["event_id", "user_id", "event_type"]
    got = e.sql("SELECT event_id, user_id, event_type FROM events").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, rows.select(columns).collect()), key=repr)
    e, _ = tables.own(spark, SF, "lineitem")
    e.sql("DELETE FROM lineitem WHERE l_orderkey < 300")
    left = tables.parquet(spark, SF, "lineitem").where("NOT l_orderkey < 300").collect()
    assert sorted(map(tuple, e.sql("SELECT * FROM lineitem").collect()), key=repr) == sorted(map(tuple, left), key=repr)
