import math
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import appdata, callgraph, chunking, ranking, search
from lodestone.plans import ingest
from lodestone.sources import files
from lodestone.streaming import status


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\rc", ["a", "b", "c"]), ("\n", [""]), (None, [])])
def test_lines(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t"))).first()[0] == want
    assert text is None or want == text.splitlines()


def test_uuid5(spark):
    import uuid

    names = ["a:1:2", "é", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


SECRET = "id_rsa id_ed25519 server.pem private.key store.p12 .env .env.production .netrc .npmrc credentials.json service-account.json secrets.yaml aws_credentials.ini my-private-key.txt db_password.txt password_utils.py".split()
OPEN = ".env.example .env.sample secrets.yaml.template app.py README.md config.py main.go id_rsa.example".split()


def test_secrets_and_noise(spark):
    got = dict(spark.createDataFrame([(n,) for n in SECRET + OPEN], "n string").select("n", files.is_secret(F.col("n"))).collect())
    assert got == {n: n in SECRET for n in SECRET + OPEN}
    noise = {"a/node_modules/x.js": True, "lib.min.js": True, "lib.MIN.js": False, "X.PNG": True, "src/build": True, "foo.egg-info/PKG": False, "src/app.py": False, "yarn.lock": True}
    assert dict(spark.createDataFrame([(n,) for n in noise], "n string").select("n", files.is_noise(F.col("n"))).collect()) == noise


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (80, 1), (99, 1), (100, 1), (101, 2), (180, 2), (181, 3)])
def test_windows(spark, n, want):
    df = spark.createDataFrame([("a/b.txt", "\n".join(map(str, range(n))))], "file_path string, source_text string")
    got = chunking.fixed_windows(df).orderBy("window").collect()
    assert len(got) == want
    if got:
        assert got[0]["start_line"] == 1 and got[-1]["end_line"] == n and got[0]["symbol_name"] == f"b[1-{min(n, 100)}]"


def test_fusion_formula(spark):
    one = lambda ids: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "query_id int, doc_id string, rank int")
    got = search.fuse(one("ab"), one("ba")).orderBy("position").collect()
    assert [r["doc_id"] for r in got] == ["a", "b"] and math.isclose(got[0]["fused"], 1 / 61 + 1 / 62, abs_tol=1e-9)


def test_cap_fills_with_overflow(spark):
    rows = [(0, i, "one", 1.0 - i / 100) for i in range(30)] + [(0, 99, "two", 0.01)]
    got = ranking.cap_per_file(spark.createDataFrame(rows, "query_id int, doc_id int, file_path string, score double")).orderBy("place").collect()
    assert len(got) == 20 and [r["doc_id"] for r in got[:6]] == [0, 1, 2, 3, 4, 99] and got[6]["overflow"]


def test_pack_first_block_is_cut(spark):
    rows = spark.createDataFrame([(0, 1, 900), (0, 2, 1)], "query_id int, place int, tokens int")
    assert [tuple(r) for r in ranking.pack_context(rows, 500).select("place", "kept_tokens").collect()] == [(1, 500)]


def test_call_graph_matches_loops(spark):
    chunks = [("a.py", "f", "1", 1, ["f", "g"]), ("b.py", "g", "2", 2, ["f", "h"]), ("c.py", "f", "3", 3, ["g"]), ("c.py", "<anonymous>", "4", 4, ["f"])]
    df = spark.createDataFrame(chunks, "file_path string, symbol_name string, chunk_id string, seq int, calls array<string>")
    table, sites = callgraph.symbols(df), callgraph.call_sites(df)
    edges = sorted(tuple(r) for r in callgraph.edges(table, sites).collect())
    assert edges == [("a.py::f", "b.py::g"), ("a.py::f", "c.py::f"), ("b.py::g", "a.py::f"), ("b.py::g", "c.py::f"), ("c.py::f", "b.py::g")]
    degrees = {r["qualified_id"]: (r["n_callees"], r["n_callers"]) for r in callgraph.degrees(table, sites).collect()}
    assert degrees == {q: (sum(s == q for s, _ in edges), sum(t == q for _, t in edges)) for q in degrees}


def test_tree_to_chunks(spark, tmp_path):
    (tmp_path / "__init__.py").write_text("import os\nclass A:\n    def b(self):\n        return go(1)\n")
    (tmp_path / ".github").mkdir()
    (tmp_path / ".github" / "w.yml").write_text("on: push\n")
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "a name.py").write_text("x = (\n")
    (tmp_path / ".env").write_text("K=1")
    got = {(r["file_path"], r["symbol_name"]) for r in ingest.chunk_tree(spark, str(tmp_path)).collect()}
    assert got == {("__init__.py", "A"), ("__init__.py", "b"), (".github/w.yml", "w[1-1]"), ("a name.py", "a name[1-1]")}


def test_split_oversized_keeps_coverage(spark):
    text = "\n".join("w w w" for _ in range(10))
    df = spark.createDataFrame([("id", "f", 1, 10, text)], "chunk_id string, symbol_name string, start_line int, end_line int, content string")
    got = chunking.split_oversized(df, 10).orderBy("start_line").collect()
    assert [x for r in got for x in range(r["start_line"], r["end_line"] + 1)] == list(range(1, 11)) and all(len(r["content"].split()) <= 10 for r in got)


def test_app_rules(spark):
    urls = {"https://github.com/o/r": True, "github.com/o/r/": True, "www.github.com/o/r": False, "http://localhost:3/o/r": False, "https://github.com/o/r//": True, "https://github.com/o/..": True, "https://github.com/" + "a" * 490 + "/r": False, "free text": False}
    assert dict(spark.createDataFrame([(u,) for u in urls], "u string").select("u", appdata.valid_url(F.col("u"))).collect()) == urls


def test_activity_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet") if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no tables")
    folder = str(tmp_path / "in")
    source.select("ts", "event_type", "value").write.parquet(folder)
    stream = status.activity(status.event_stream(spark, folder, source.select("ts", "event_type", "value").schema)).writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "c")).start()
    stream.processAllAvailable()
    stream.stop()
    assert sorted(map(tuple, spark.table("activity").collect())) == sorted(map(tuple, status.activity(source).collect()))
