"""Queries that have SQL give that SQL's rows."""

import os

import pytest

from segtable.cluster import ship
from segtable.llm import queries as registered

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", registered.oracle_sql())
def test_query_equals_sql(spark, name):
    import duckdb

    ship(spark)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    df = registered.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(got.fetchall())
