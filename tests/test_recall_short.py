"""Items of few words count in the recall as in its SQL."""

import duckdb

from lodestone import queries as own


def test_short_items(spark, tmp_path):
    docs = ["the old stone walls stand near the quiet river bank", "a quiet river", "stone walls and the river", "riverbank", "", None]
    items = ["river", "quiet river", "stone walls stand", "ston", "the old stone walls stand near the", "the old stone walls stand near the quiet", "nowhere", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(duck.sql(own.oracle_sql()["recall_at_10"]).fetchall())
    got = own.queries()["recall_at_10"](spark, str(tmp_path)).select("query_id", "relevant", "found").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 6
