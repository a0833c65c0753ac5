"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(tuple(str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in plain.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = own.queries()[name](spark, SF).toPandas(), duck.sql(own.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
