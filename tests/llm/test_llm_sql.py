"""Text queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siltgrid.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, got = c.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, DATA).toPandas()
    assert sorted(map(tuple, want.values.tolist())) == sorted(map(tuple, got[list(want.columns)].values.tolist()))
