"""Every query with SQL against DuckDB on the smallest tables, where they are there."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def cell(v):
    if pd.isna(v):
        return "null"
    return str(v) if isinstance(v, (bool, str)) else repr(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() >= 0
