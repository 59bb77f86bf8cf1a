"""Queries against their SQL in DuckDB, on the small tables."""

import glob
import os

import duckdb
import pytest

from curatrix.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf):
    c = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    got = c.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(got.fetchall())
