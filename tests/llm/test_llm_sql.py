"""Corpus queries with SQL agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = queries.queries()[name](spark, SF)
    columns = ours.columns
    theirs = con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs))
