"""The call graph and what is expanded by it, at size: no pair is made twice, no text goes along with a pair."""

import random

from pyspark.sql import functions as F

from lodestone.operators import callgraph, ranking, search
from lodestone.functions.text import words
from lodestone.plans import ask


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def chunks(spark, n=60):
    rng = random.Random(5)
    rows = [(f"f{i % 50}.py", rng.choice("abcde") if i % 9 else "<anonymous>", i, i, rng.choices("abcdexyz", k=rng.randint(0, 4))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "file_path string, symbol_name string, chunk_id long, seq long, calls array<string>").repartition(3)


def loops(rows, seeds):
    last = {f"{p}::{s}": (s, c) for p, s, c, _, _ in rows if s != "<anonymous>"}
    sites = {(f"{p}::{s}", x) for p, s, _, _, calls in rows if s != "<anonymous>" for x in calls}
    out = set()
    for q, chunk in seeds:
        for own, (name, c) in last.items():
            if c == chunk:
                out |= {(q, last[src][1]) for src, x in sites if x == name}
                out |= {(q, k) for _, x in sites & {(own, x) for _, x in sites} for s, k in last.values() if s == x}
    return out - set(seeds)


def test_neighbours_match_loops(spark):
    rows, df = chunks(spark)
    seeds = [(q, c) for q in (3, 4, 9) for c in range(q, 60, 7)]
    for some in (seeds, seeds[:1], []):
        got = callgraph.expand(spark.createDataFrame(some, "query_id long, chunk_id long"), callgraph.symbols(df), callgraph.call_sites(df))
        assert "Join" not in plan(got) and "Aggregate" not in plan(got)
        found = [tuple(r) for r in got.select("query_id", "chunk_id").collect()]
        assert len(found) == len(set(found)) and set(found) == loops(rows, some)


def test_overlap_of_pairs(spark):
    texts = [(1, "red red blue"), (2, ""), (3, None), (4, "grey Blue x")]
    asked = spark.createDataFrame([(7, "blue red"), (8, "Grey grey y"), (9, "?")], "query_id long, question string")
    docs = spark.createDataFrame(texts, "doc_id long, content string")
    pairs = spark.createDataFrame([(1, [7, 8]), (2, [7]), (3, [8]), (4, [9, 7, 8])], "doc_id long, queries array<long>")
    got = search.overlap_of(pairs, docs.select("doc_id", words(F.col("content")).alias("w")), asked)
    want = docs.join(pairs.select("doc_id", F.explode("queries").alias("query_id")), "doc_id").join(asked, "query_id").select("query_id", "doc_id", ranking.overlap_score(F.col("question"), F.col("content")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 7


def test_only_cited_spans_are_gathered(spark):
    files = ["a b/x.py", "src/m.py", *(f"d/f{i}.py" for i in range(300))]
    docs = spark.createDataFrame([(i, p, 1, 9) for i, p in enumerate(files)], "doc_id long, file_path string, start_line int, end_line int")
    places = docs.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("query_id"), "doc_id")
    said = spark.createDataFrame([(0, "see a b/x.py:3 and m.py:5"), (1, "see f7.py:2"), (2, "f8.py:1"), (3, None)], "query_id long, answer string")
    got = {r["query_id"]: sorted(c["file_path"] for c in r["chunks"]) for r in ask.cited(said, places, docs, "answer").collect()}
    assert got == {0: ["a b/x.py", "src/m.py"], 1: ["d/f7.py"]}


def test_texts_join_rows_that_fit(spark):
    docs = spark.createDataFrame([(i, f"f{i}", "s", 1, 1, "w " * 10 if i != 3 else None) for i in range(40)], "doc_id long, file_path string, symbol_name string, start_line int, end_line int, content string")
    places = docs.select(F.lit(0).alias("query_id"), "doc_id", (F.col("doc_id") + 1).cast("int").alias("place"))
    got = ask.packed(places, docs, 30).orderBy("place").collect()
    assert [(r["doc_id"], r["running"]) for r in got] == [(0, 14), (1, 28)]
    got = ask.packed(places.where("doc_id > 2").withColumn("place", F.col("place") - 3), docs, 14).orderBy("place").collect()
    assert [(r["doc_id"], r["running"], r["block_text"] is None) for r in got] == [(3, 0, True), (4, 14, False)]


def test_saved_calls_grow_with_symbols(spark, tmp_path):
    _, df = chunks(spark, 200)
    table, sites = callgraph.symbols(df), callgraph.call_sites(df)
    callgraph.save_calls(table, sites, str(tmp_path), "c")
    rows = lambda d: sorted((r["qualified_id"], str(r["chunk_id"]), r["callers"], r["callees"]) for r in d.collect())
    assert rows(callgraph.load_graph(spark, str(tmp_path), "c")) == rows(callgraph.nested(table, sites))
    # Ten times the definitions of a name that all call: the folder grows as they do, not as their pairs.
    sizes = []
    for n in (100, 1000):
        many = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), F.lit("go").alias("symbol_name"), F.col("id").alias("chunk_id"), F.col("id").alias("seq"), F.array(F.lit("go")).alias("calls"))
        callgraph.save_calls(callgraph.symbols(many), callgraph.call_sites(many), str(tmp_path), f"n{n}")
        sizes.append(sum(p.stat().st_size for p in (tmp_path / f"n{n}").rglob("*.json")))
    assert sizes[1] < 12 * sizes[0]


def test_degrees_read_calls_once_by_name(spark):
    rows, df = chunks(spark, 200)
    got = callgraph.degrees(callgraph.symbols(df), callgraph.call_sites(df))
    nested = callgraph.nested(callgraph.symbols(df), callgraph.call_sites(df))
    assert sorted(map(tuple, got.collect())) == sorted((r["qualified_id"], len(r["callees"]), len(r["callers"])) for r in nested.collect())
    # No call is shuffled by the name that is called: a common one would meet in one task.
    assert "hashpartitioning(called" not in plan(got)
