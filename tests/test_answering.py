"""The answer path, providers, outlines and the semantic strategy, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone import providers
from lodestone.operators import appdata, callgraph, chunking, citations, evaluation, ranking
from lodestone.plans import ask, ingest


def liar():
    """Cites what isn't there, then what is. Made inside, so that workers need not import this module."""

    class Liar:
        def complete(self, system, user):
            return "See made/up.py:1-2." if "Cite only" not in user else "See " + user.rsplit("Cite only: ", 1)[1].split(", ")[0] + ":1."

    return Liar


def stubborn():
    class Stubborn:
        def complete(self, system, user):
            return "no citation"

    return Stubborn


CHUNKS = [(1, "a.py", "alpha", 1, 3, "alpha beta gamma"), (2, "b.py", "beta", 1, 2, "beta delta"), (3, "c.py", "gamma", 1, 1, "calls nothing")]


def answers(spark, chat, places=((0, 1, 0.9, 1), (0, 2, 0.5, 2))):
    chunks = spark.createDataFrame(CHUNKS, "doc_id long, file_path string, symbol_name string, start_line int, end_line int, content string")
    questions = spark.createDataFrame([(0, "what is alpha"), (9, "nothing found")], "query_id long, question string")
    rows = spark.createDataFrame(list(places), "query_id long, doc_id long, score double, place int").withColumn("expanded", F.lit(False))
    return {r["query_id"]: (r["answer"], r["outcome"]) for r in ask.answered(rows, chunks, questions, chat=chat).collect()}


def test_gate(spark):
    none = (citations.REFUSAL, "refused_no_context")
    assert answers(spark, providers.ExtractiveChat) == {0: ("See a.py:1-3.", "answered"), 9: none}
    assert answers(spark, liar()) == {0: ("See a.py:1.", "answered_retry"), 9: none}
    assert answers(spark, stubborn()) == {0: (citations.REFUSAL, "refused_closed"), 9: none}


def test_context_is_cut_to_its_budget(spark):
    chunks = spark.createDataFrame([(1, "a.py", "f", 1, 9, "w " * 900), (2, "b.py", "g", 1, 1, "x")], "doc_id long, file_path string, symbol_name string, start_line int, end_line int, content string")
    places = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 0.5, 2)], "query_id long, doc_id long, score double, place int")
    text = ranking.context_text(ask.packed(places, chunks, 500), 500).first()["context"]
    assert text.startswith("### a.py:1-9 (f)\n```\nw w") and len(providers.WORD.findall(text)) == 500


@pytest.mark.parametrize("question,top,want", [("who calls get_active_run", 0.1, True), ("trace the execution path", 0.9, False), ("trace the execution path", 0.5, False), ("what does app.py do", 0.01, False), ("which functions depend on this", 0.49, True)])
def test_routes(spark, question, top, want):
    kept = spark.createDataFrame([(0, 1, top)], "query_id int, place int, score double")
    asked = spark.createDataFrame([(0, question, None), (1, question, None)], "query_id int, question string, search string")
    got = {r["query_id"]: r["expands"] for r in ask.routed(kept, asked).collect()}
    assert got[0] == want and got[1] == ("app.py" not in question)


def test_expanded_rows_follow_kept_ones(spark):
    kept = spark.createDataFrame([(0, 5, 0.1, 1), (0, 6, 0.05, 2)], "query_id int, doc_id int, score double, place int")
    extras = spark.createDataFrame([(0, 7, 0.9), (0, 8, 0.9), (0, 9, 0.95), (1, 3, 0.2)], "query_id int, doc_id int, score double")
    got = [(r["query_id"], r["doc_id"], r["place"], r["expanded"]) for r in ranking.append_expanded(kept, extras).orderBy("query_id", "place").collect()]
    assert got == [(0, 5, 1, False), (0, 6, 2, False), (0, 9, 3, True), (0, 7, 4, True), (0, 8, 5, True), (1, 3, 1, True)]


def test_hosted_reranker():
    seen = []

    def rank(query, documents):
        seen.append([len(d) for d in documents])
        return [(2, 0.9), (0, 0.4)]

    one = providers.HostedReranker(rank)
    assert one.predict([]) == [] and one.predict([("q", "a"), ("q", "b" * 5000), ("q", "c")]) == [0.4, 0.0, 0.9] and seen == [[1, 2000, 1]]
    with pytest.raises(ValueError):
        one.predict([("q", "a"), ("p", "a")])


def test_providers(spark):
    embedder = providers.HashedEmbedder(8)
    assert embedder.embed([]) == [] and embedder.embed(["b a", "x"])[0] == embedder.embed_one("a B") and sum(embedder.embed_one("a b b")) == 3
    words = providers.WordTokenizer()
    assert providers.truncated("a b a c", 3, words) == "a b a" and providers.truncated("a  b", 3, words) == "a  b"
    rows = spark.createDataFrame([("p", "q1"), (" r ", "q2"), ("", "q3"), (None, "q4")], "answer string, question string")
    assert [r[0] for r in rows.select(providers.rewritten(F.col("question"), F.col("answer"))).collect()] == ["p", "r", "q3", "q4"]


def judge():
    class Judge:
        def score(self, metric, question, answer, contexts):
            if metric == "down":
                raise ConnectionError
            return len(contexts) / 2

    return Judge


def test_judged_cases(spark):
    cases = spark.createDataFrame([("q", "a", ["x"]), ("q", "a", ["x", "y"])], "question string, answer string, contexts array<string>")
    got = {r["metric"]: (r["n"], r["mean"], r["verdict"]) for r in evaluation.verdicts(evaluation.judged(cases, judge(), {"recall": 0.75, "down": 0.7})).collect()}
    assert got == {"recall": (2, 0.75, "PASS"), "down": (0, None, "n/a")}


def test_python_outline_lines():
    text = "import os\n\x0c\ndef f():\n    return '\x0b'\nclass Ü: x = 1; y = 'ü'\n"
    assert chunking.python_outline(text) == [("function_definition", "f", 3, 4, "def f():\n    return '\x0b'"), ("class_definition", "Ü", 5, 5, "class Ü: x = 1; y = 'ü'")]
    assert chunking.python_outline("x = " + "(" * 5000 + ")" * 5000) == [] and chunking.python_outline("x = " + "-" * 100_000 + "1") == []
    assert chunking.python_outline("x = (") == [] and chunking.python_outline("\x00") == []


OUTLINES = {
    "javascript": ("// function no() {}\nclass A {\n  go(x) { if (x) { return '}'; } }\n}\nconst f = (a) => { return a; };\nfunction* g() {}\n", [("class_declaration", "A"), ("method_definition", "go"), ("arrow_function", "f"), ("generator_function_declaration", "g")]),
    "java": ("interface I { int n(); }\nclass B {\n  public int go(int x) throws E { for (;;) { } }\n}\n", [("interface_declaration", "I"), ("class_declaration", "B"), ("method_declaration", "go")]),
    "rust": ("fn a() -> u8 { 1 }\nimpl Show for P { fn b(&self) {} }\nstruct S { x: u8 }\ntrait T { }\n", [("function_item", "a"), ("impl_item", "P"), ("function_item", "b"), ("struct_item", "S"), ("trait_item", "T")]),
    "c": ("int add(int a) {\n  return a;\n}\nint decl(int);\nstruct S { int x; };\n", [("function_definition", "add"), ("struct_specifier", "S")]),
    "ruby": ("module M\n  class C\n    def go?\n      1\n    end\n  end\nend\n", [("module", "M"), ("class", "C"), ("method", "go?")]),
    "php": ("<?php\nfunction a() { return 1; }\nclass C { function b() { } }\n", [("function_definition", "a"), ("class_declaration", "C"), ("function_definition", "b")]),
    "scala": ("object O { def a(x: Int) = { x } }\nclass C { }\n", [("object_definition", "O"), ("function_definition", "a"), ("class_definition", "C")]),
    "kotlin": ("class K { fun a(x: Int) { } }\n", [("class_declaration", "K"), ("function_declaration", "a")]),
    "swift": ("class K { func a(x: Int) { } }\n", [("class_declaration", "K"), ("function_declaration", "a")]),
    "typescript": ("interface I { a: string }\nexport class C { m(): void { } }\n", [("interface_declaration", "I"), ("class_declaration", "C"), ("method_definition", "m")]),
    "go": ("type S struct {\n}\nfunc (s *S) A() {\n}\nfunc B() {\n}\n", [("type_declaration", "S"), ("method_declaration", "A"), ("function_declaration", "B")]),
    "c_sharp": ("class C { public void M(int a) { } }\n", [("class_declaration", "C"), ("method_declaration", "M")]),
    "cpp": ("class C { };\nstruct S { };\nvoid C::f(int a) {\n}\n", [("class_specifier", "C"), ("struct_specifier", "S"), ("function_definition", "f")]),
}


@pytest.mark.parametrize("language", sorted(OUTLINES))
def test_outlines(language):
    source, want = OUTLINES[language]
    got = chunking.outline(source, language)
    assert [(k, n) for k, n, *_ in got] == want
    rows = source.split("\n")
    for _, _, first, last, content in got:
        assert "\n".join(rows[first - 1 : last]).count(content) == 1
    assert chunking.outline("}}{{ ((", language) == [] and chunking.outline("", language) == []


def spans(n, breaks, least=6, most=120):
    """Spans over units of four lines by loops."""
    if n < 12:
        out = [(0, n)]
    else:
        units = [(i, min(i + 4, n)) for i in range(0, n, 4)]
        out, start = [], 0
        for i, (_, b) in enumerate(units):
            if i in breaks or i == len(units) - 1:
                out.append((start, b))
                start = b
    merged = []
    for s in out:
        if merged and s[1] - s[0] < least:
            merged[-1] = (merged[-1][0], s[1])
        else:
            merged.append(s)
    cut = []
    for a, b in merged:
        step = math.ceil((b - a) / math.ceil((b - a) / most)) if b - a > most else max(1, b - a)
        cut += [(x, min(x + step, b)) for x in range(a, b, step)]
    return cut


def test_semantic_spans_match_loops(spark):
    import numpy as np

    texts = {f"f{n}.txt": "\n".join(f"{'red' if i // 10 % 2 else 'blue'} {'w%d' % (i % 7)}" for i in range(n)) for n in (1, 3, 11, 12, 13, 40, 100, 700)}
    df = spark.createDataFrame([*texts.items(), ("empty.txt", ""), ("null.txt", None), ("blank.txt", "\n" * 30)], "file_path string, source_text string")
    got = {}
    for r in chunking.semantic_spans(df).collect():
        got.setdefault(r["file_path"], []).append((r["start"], r["end"]))
    embedder = providers.HashedEmbedder()
    for path, text in texts.items():
        rows = text.split("\n")
        n = len(rows)
        vectors = [np.array(embedder.embed_one("\n".join(rows[max(0, i - 4) : i + 8]))) for i in range(0, n, 4)] if n >= 12 else []
        distance = np.array([round(1 - float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), 9) for a, b in zip(vectors[:-1], vectors[1:], strict=True)])
        breaks = set(np.flatnonzero(distance > round(float(np.percentile(distance, 90)), 9)).tolist()) if len(distance) else set()
        assert sorted(got[path]) == spans(n, breaks), path
    assert set(got) == {*texts, "blank.txt"}
    assert {r["file_path"] for r in chunking.semantic_chunks(df).collect()} == set(texts)


def test_strategies(spark):
    df = spark.createDataFrame([("a.py", "python", "def f(x):\n    return g(x)\n"), ("b.go", "go", "func G() {\n\tF()\n}\n"), ("c.txt", "text", "plain words\n")], "file_path string, language string, source_text string")
    one = {(r["file_path"], r["symbol_name"], r["symbol_type"], tuple(r["calls"])) for r in ingest.chunk_files(df).collect()}
    assert one == {("a.py", "f", "function_definition", ("f", "g")), ("b.go", "G", "function_declaration", ("F", "G")), ("c.txt", "c[1-1]", "text_window", ())}
    two = {(r["file_path"], r["symbol_name"], r["symbol_type"], r["language"]) for r in ingest.chunk_files(df, "semantic").collect()}
    assert two == {("a.py", "f", "semantic_chunk", "python"), ("b.go", "G", "semantic_chunk", "go"), ("c.txt", "c[1-1]", "semantic_chunk", "text")}
    with pytest.raises(ValueError):
        ingest.chunk_files(df, "other")
    assert ingest.chunk_files(df.limit(0)).count() == 0
    assert ingest.counters(df, ingest.chunk_files(df)).first().asDict() == {"files_scanned": 3, "files_skipped": 0, "total_chunks": 3}


def test_graph_of_an_unknown_collection_is_empty(spark, tmp_path):
    assert callgraph.load_graph(spark, str(tmp_path), "none").count() == 0


def test_application_rules(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "seq int, email string")
    known = spark.createDataFrame([("b",)], "email string")
    assert {r["seq"]: r["status"] for r in appdata.new_accounts(known, asked).collect()} == {1: 201, 2: 409, 3: 409, 4: 201}
    log = spark.createDataFrame([("r", i, s) for i, s in enumerate(["pending", "ingesting", "ready", "ready", "pending", "failed", None])], "repo string, at int, status string")
    assert [r["legal"] for r in appdata.transitions(log, "repo", ["at"]).orderBy("at").collect()] == [True, True, True, False, True, False, False]
    rows = spark.createDataFrame([(1, "q", "a", False), (2, "q", None, False)], "conv_id int, question string, answer string, refused boolean")
    assert sorted((r["conv_id"], r["seq"], r["role"]) for r in appdata.exchange(rows).collect()) == [(1, 0, "user"), (1, 1, "assistant")]
