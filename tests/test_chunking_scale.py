"""Cutting at size: a file's units stay together, and few rows are objects at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.providers import HashedEmbedder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_semantic_chunks_shuffle_nothing(spark):
    text = "\n".join(f"{'red' if i // 10 % 2 else 'blue'} w{i % 7}" for i in range(90))
    df = spark.createDataFrame([("a.txt", "text", text), ("b.txt", "text", "one\ntwo"), ("c.txt", "text", None), ("d.txt", "text", "\n" * 30)], "file_path string, language string, source_text string")
    got = chunking.semantic_chunks(df)
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    rows = sorted((r["file_path"], r["start_line"], r["end_line"]) for r in got.collect())
    assert rows[-1] == ("b.txt", 1, 2) and [r[1] for r in rows[:-1]] == [1, *(r[2] + 1 for r in rows[:-2])] and rows[-2][2] == 90 and len(rows) > 3
    # What the steps over tables of units say.
    units = chunking.semantic_units(df).withColumn("v", F.udf(lambda t: HashedEmbedder().embed_one(t), "array<double>")("unit_text"))
    flags = chunking.span_breaks(units.where("file_path = 'a.txt'"), "file_path", "unit", "v").orderBy("unit").select("ends").collect()
    assert [r[0] for r in flags] == chunking.breaks(HashedEmbedder().embed(chunking.unit_texts(text.split("\n")))).tolist()


def test_split_holds_few_rows(monkeypatch):
    seen = []

    class Plan:
        columns = ["chunk_id", "symbol_name", "start_line", "end_line", "content"]
        schema = None
        select = lambda self, *_: self
        mapInArrow = mapInPandas = lambda self, run, _: run

    monkeypatch.setattr(chunking.F, "col", lambda _: type("C", (), {"cast": lambda s, _: s, "alias": lambda s, _: s})())
    run = chunking.split_oversized(Plan(), 50)
    batch = pa.RecordBatch.from_pylist([{"chunk_id": str(i), "symbol_name": "f", "start_line": 1, "end_line": 200, "content": "w w w w w\n" * 2000} for i in range(1500)])
    for part in run([batch]):
        seen.append(part.nbytes)
    assert len(seen) > 5 and max(seen) < 3 * chunking.SPLIT_BYTES
