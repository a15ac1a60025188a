"""Each query with SQL equals it on the small tables; each other one runs and has rows."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if n.startswith("q_")]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def table(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert table(got) == table(duck.sql(sql).df().astype(got.dtypes.to_dict(), errors="ignore"))
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "name", "n_tracks", "covers"]
