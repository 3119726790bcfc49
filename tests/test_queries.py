"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from siltgrid.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(df, columns):
    df = df[columns].copy()
    for c in columns:
        if str(df[c].dtype).startswith("datetime") or df[c].dtype == object:
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "")
    return df.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    want, got = duck.execute(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(norm(want, columns), norm(got, columns), check_dtype=False, rtol=0, atol=0)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "dispersion", "sum_amp"] and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
