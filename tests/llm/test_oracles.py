"""Queries of the training-data operators that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == names
    want = sorted((tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want
