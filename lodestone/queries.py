"""Queries over the driver's tables for every operator, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import appdata, callgraph, chunking, citations, evaluation, ranking, search
from lodestone.plans.ask import ask
from lodestone.registry import QUERIES, SQL, Query, query
from lodestone.session import importable, saved, small, table
from lodestone.sources import files

NAMES = ["id_rsa", "server.pem", ".env.example", "secrets.yaml", "credentials.json", "my-private-key.txt", "app.py", "README.md", "main.go", "lib.min.js", "X.PNG", "yarn.lock", "build", "password_utils.py", "view.tsx", "Tool.KT", "id_rsa.example", "a.b.rs", ".gitignore", "core.cpp"]


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_EXT = r"lower(regexp_extract(name, '[^.].*(\.[^.]+)$', 1))"
_LANG = " ".join(f"WHEN {_EXT} IN ({_sql_list(s)}) THEN '{n}'" for n, s in files.LANGUAGES.items())


@query(
    f"""WITH named AS (SELECT doc_id, coalesce(source, '') || '/' || ([{_sql_list(NAMES)}])[(doc_id % {len(NAMES)}) + 1] AS path, ([{_sql_list(NAMES)}])[(doc_id % {len(NAMES)}) + 1] AS name, n_chars FROM documents)
SELECT doc_id, path,
  (list_has_any(string_split(path, '/'), [{_sql_list(files.NOISE_PARTS)}]) OR name IN ({_sql_list(files.NOISE_NAMES)}) OR {_EXT} IN ({_sql_list(files.NOISE_SUFFIXES)}) OR ends_with(name, '.min.js') OR ends_with(name, '.min.css')) AS noise,
  (NOT regexp_matches(lower(name), '(\\.example|\\.sample|\\.template|\\.dist)$') AND (lower(name) IN ({_sql_list(files.SECRET_NAMES)}) OR {_EXT} IN ({_sql_list(files.SECRET_SUFFIXES)}) OR regexp_matches(lower(name), '{"|".join(files.SECRET_WORDS)}'))) AS secret,
  CASE {_LANG} ELSE 'text' END AS language, n_chars BETWEEN 1 AND 1000000 AS fits FROM named""".replace("\\\\", "\\")
)
def file_predicates(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), name)
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "n_chars").select("doc_id", "path", files.is_noise(F.col("path")).alias("noise"), files.is_secret(F.col("path")).alias("secret"), files.language(F.col("path")).alias("language"), files.right_size(F.col("n_chars")).alias("fits"))


@query(
    r"""WITH asked AS (SELECT page_id, unnest([url, ' https://github.com/own-' || page_id || '/Repo.x// ', 'github.com/o/r' || page_id, 'https://github.com.evil.com/o/r', 'https://github.com/o', 'www.github.com/o/r']) AS url, unnest(range(6)) AS kind FROM pages),
clean AS (SELECT *, regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '/+$', '') AS bare FROM asked),
named AS (SELECT *, CASE WHEN starts_with(bare, 'github.com/') THEN 'https://' || bare ELSE bare END AS address FROM clean)
SELECT page_id, kind::INT AS kind, address, coalesce(length(url) BETWEEN 1 AND 500 AND regexp_matches(address, '^https?://(?:www\.)?github\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+/?$'), false) AS ok FROM named"""
)
def url_validate(spark, d):
    p = F.col("page_id").cast("string")
    urls = F.array(F.col("url"), F.concat(F.lit(" https://github.com/own-"), p, F.lit("/Repo.x// ")), F.concat(F.lit("github.com/o/r"), p), F.lit("https://github.com.evil.com/o/r"), F.lit("https://github.com/o"), F.lit("www.github.com/o/r"))
    return table(spark, d, "pages").select("page_id", F.posexplode(urls).alias("kind", "url")).select("page_id", "kind", appdata.normal_url(F.col("url")).alias("address"), appdata.valid_url(F.col("url")).alias("ok"))


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, l, unnest(range(0, greatest(0, ceil((len(l) - {size}) / {step}.0))::INT + 1)) AS w FROM cut),
named AS (SELECT doc_id, w::INT AS "window", (w * {step} + 1)::INT AS start_line, least(w * {step} + {size}, len(l))::INT AS end_line, md5(array_to_string(l[w * {step} + 1:w * {step} + {size}], chr(10))) AS content_md5 FROM w),
hashed AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id || ':' || start_line || ':' || end_line)) AS h FROM named)
SELECT doc_id, "window", start_line, end_line, content_md5, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||printf('%02x', (('0x'||substr(h,17,2))::INT & 63) | 128)||substr(h,19,2)||'-'||substr(h,21,12) AS chunk_id FROM hashed"""


def _windows(spark, d, size, overlap):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("source_text"))
    return chunking.fixed_windows(docs, size, overlap).select("doc_id", "window", "start_line", "end_line", F.md5("content").alias("content_md5"), "chunk_id")


@query(_windows_sql(100, 20))
def fixed_windows(spark, d):
    return _windows(spark, d, 100, 20)


@query(_windows_sql(5, 1))
def fixed_windows_small(spark, d):
    return _windows(spark, d, 5, 1)


_LOCAL = "[A-Za-zÀ-ɏ]+"


@query(
    f"""WITH c AS (SELECT doc_id, lower(regexp_extract(text, '^{_LOCAL}')) AS name, list_sort(list_distinct(regexp_extract_all(text, '({_LOCAL}),', 1))) AS calls FROM documents)
SELECT doc_id, name, array_to_string(calls, ' ') AS calls FROM c"""
)
def calls_extract(spark, d):
    return _call_chunks(spark, d).select("doc_id", F.col("symbol_name").alias("name"), F.array_join("calls", " ").alias("calls"))


def _call_chunks(spark, d):
    """Documents as chunks: the first word is the symbol, words before a comma are calls."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("file_path"), F.lower(F.regexp_extract("text", f"^{_LOCAL}", 0)).alias("symbol_name"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"), chunking.calls(F.col("text"), f"({_LOCAL}),").alias("calls"))


_CALLS_SQL = f"""WITH s AS (SELECT doc_id, doc_id || '::' || lower(regexp_extract(text, '^{_LOCAL}')) AS qualified_id, lower(regexp_extract(text, '^{_LOCAL}')) AS name, text FROM documents WHERE text IS NOT NULL),
sites AS (SELECT qualified_id, unnest(list_filter(list_distinct(regexp_extract_all(text, '({_LOCAL}),', 1)), lambda x: x NOT IN ({_sql_list(chunking.NO_CALLS)}))) AS called FROM s),
e AS (SELECT t.qualified_id AS src, s.qualified_id AS dst, s.doc_id AS dst_id FROM sites t JOIN s ON s.name = t.called WHERE s.qualified_id <> t.qualified_id)"""

SQL["calls_extract"] = f"""WITH c AS (SELECT doc_id, lower(regexp_extract(text, '^{_LOCAL}')) AS name, list_sort(list_filter(list_distinct(regexp_extract_all(text, '({_LOCAL}),', 1)), lambda x: x NOT IN ({_sql_list(chunking.NO_CALLS)}))) AS calls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, name, array_to_string(calls, ' ') AS calls FROM c"""


@query(_CALLS_SQL + " SELECT s.qualified_id, (SELECT count(*) FROM e WHERE e.src = s.qualified_id) AS n_callees, (SELECT count(*) FROM e WHERE e.dst = s.qualified_id) AS n_callers FROM s")
def call_graph_degrees(spark, d):
    chunks = saved(_call_chunks(spark, d), "chunks")
    return callgraph.degrees(callgraph.symbols(chunks), callgraph.call_sites(chunks))


_DIST = "list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))"


@query(
    f"""WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
x AS (SELECT label, vec_id, CASE WHEN w IS NOT NULL THEN round(1.0 - {_DIST}, 9) END AS distance FROM u),
t AS (SELECT label, round(quantile_cont(distance, 0.9), 9) AS threshold FROM x GROUP BY label)
SELECT vec_id, round(distance, 6) AS distance, coalesce(distance > threshold, false) AS ends FROM x JOIN t USING (label)"""
)
def semantic_breaks(spark, d):
    return chunking.span_breaks(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"), "ends")


@query(
    """WITH p AS (SELECT o_custkey, o_orderkey, (o_orderkey % 160 + 1) AS n FROM orders),
s AS (SELECT o_custkey, (sum(n) OVER w - n)::BIGINT AS "start", (sum(n) OVER w)::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
a AS (SELECT *, CASE WHEN row_number() OVER v = 1 OR "end" - "start" >= 6 THEN 1 ELSE 0 END AS alone FROM s WINDOW v AS (PARTITION BY o_custkey ORDER BY "start")),
g AS (SELECT *, sum(alone) OVER (PARTITION BY o_custkey ORDER BY "start") AS g FROM a),
m AS (SELECT o_custkey, min("start") AS a, max("end") AS b FROM g GROUP BY o_custkey, g),
k AS (SELECT *, CASE WHEN b - a > 120 THEN ceil((b - a) / ceil((b - a) / 120.0)) ELSE greatest(b - a, 1) END::BIGINT AS step FROM m),
e AS (SELECT o_custkey, b, step, unnest(range(a, b, step)) AS x FROM k)
SELECT o_custkey, x::BIGINT AS "start", least(x + step, b)::BIGINT AS "end" FROM e"""
)
def semantic_spans(spark, d):
    n = F.col("o_orderkey") % 160 + 1
    running = F.sum(n).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    spans = table(spark, d, "orders").select("o_custkey", (running - n).alias("start"), running.alias("end"))
    return chunking.limit_spans(spans, "o_custkey")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BM25 = rf"""q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
size AS (SELECT count(*)::DOUBLE AS n, avg(coalesce(len(w), 0)::DOUBLE) AS mean FROM tok),
post AS (SELECT doc_id, term, any_value(dl)::DOUBLE AS dl, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))), 5) AS score FROM q JOIN post USING (term) JOIN df USING (term), size GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100),
ov AS (SELECT query_id, doc_id, round(count(*)::DOUBLE / any_value(many)::DOUBLE, 6) AS score FROM q JOIN (SELECT query_id, count(*) AS many FROM q GROUP BY 1) USING (query_id) JOIN (SELECT DISTINCT doc_id, unnest(w) AS term FROM tok) USING (term) GROUP BY 1, 2),
ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ov QUALIFY rank <= 100),
fu AS (SELECT query_id, doc_id, a.rank AS rank_a, b.rank AS rank_b, round(coalesce(1e0 / (60 + a.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0), 9) AS fused FROM bmr a FULL OUTER JOIN ovr b USING (query_id, doc_id)),
fur AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, rank_a NULLS LAST, rank_b NULLS LAST) AS position FROM fu QUALIFY position <= 100)"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank::INT AS rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark, d):
    return search.bm25_topk(table(spark, d, "documents"), _questions(spark, d), 10)


@query(f"WITH {_BM25} SELECT query_id, doc_id, fused, position::INT AS position FROM fur")
def rrf_fuse(spark, d):
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    return search.fuse(*search.lexical_lists(docs, q)).select("query_id", "doc_id", "fused", "position")


@query(f"WITH {_BM25} SELECT query_id, count(*) AS n FROM bmr JOIN ovr USING (query_id, doc_id) GROUP BY 1")
def rrf_agreement(spark, d):
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    return search.agreement(*search.lexical_lists(docs, q))


_KEPT = r"""boost AS (SELECT f.*, d.source AS file_path, lower(split_part(d.text, ' ', 1)) AS symbol, len(regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+')) AS tokens, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_./-]+\.[\p{L}\p{N}_]+|[\p{L}\p{N}_]{4,}')) AS named FROM fur f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id),
sc AS (SELECT *, fused + CASE WHEN coalesce(list_contains(named, lower(file_path)), false) THEN 1e0 ELSE 0e0 END + CASE WHEN coalesce(list_contains(named, symbol), false) THEN 1e0 ELSE 0e0 END AS score FROM boost),
inf AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, doc_id) AS in_file FROM sc),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_file > 5, score DESC, doc_id) AS place FROM inf QUALIFY place <= 20)"""


def _kept(spark, d):
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    fused = search.fuse(*search.lexical_lists(docs, q))
    # The candidates go to the documents: only their rows are cut into words, and no text is shuffled.
    about = docs.join(small(fused, "fused"), "doc_id").select("query_id", "doc_id", "fused", F.col("source").alias("file_path"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("symbol"), F.size(T.words(F.col("text"))).alias("tokens"))
    rows = about.join(q, "query_id")
    return ranking.cap_per_file(rows.withColumn("score", ranking.boosted(F.col("fused"), F.col("question"), F.col("file_path"), F.col("symbol"))))


@query(f"WITH {_BM25}, {_KEPT} SELECT query_id, doc_id, round(score, 6) AS score, place::INT AS place FROM kept")
def boost_and_cap(spark, d):
    return _kept(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


@query(
    f"""{_CALLS_SQL}, {_BM25}, {_KEPT}, seeds AS (SELECT k.query_id, s.doc_id, s.qualified_id FROM kept k JOIN s USING (doc_id))
SELECT DISTINCT q.query_id, n.doc_id AS chunk_id FROM seeds q JOIN (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) x ON x.a = q.qualified_id JOIN s n ON n.qualified_id = x.b
WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = q.query_id AND z.doc_id = n.doc_id)"""
)
def graph_expand(spark, d):
    chunks = _call_chunks(spark, d)
    seeds = _kept(spark, d).select("query_id", F.col("doc_id").alias("chunk_id"))
    return callgraph.expand(seeds, callgraph.symbols(chunks), callgraph.call_sites(chunks))


@query(f"WITH {_BM25}, {_KEPT}, run AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS running FROM kept) SELECT query_id, doc_id, place::INT AS place, running::BIGINT AS running, least(tokens, 8000)::INT AS kept_tokens FROM run WHERE running <= 8000 OR place = 1")
def context_pack(spark, d):
    return ranking.pack_context(_kept(spark, d)).select("query_id", "doc_id", "place", "running", "kept_tokens")


@query(f"WITH {_BM25} SELECT b.item_id AS query_id, count(*) AS relevant, count(r.doc_id) AS found FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN (SELECT * FROM bmr WHERE rank <= 10) r ON r.query_id = b.item_id AND r.doc_id = d.doc_id GROUP BY 1")
def recall_at_10(spark, d):
    docs, q = table(spark, d, "documents"), _questions(spark, d)
    return evaluation.recall(search.bm25_topk(docs, q, 10), search.containing(docs, q), 10)


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= 10"""
)
def cosine_topk(spark, d):
    v = table(importable(spark), d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return search.cosine_topk(v, v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 10)


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)\b(?:calls?|callers?|callees?|invoke[sd]?|who\s+uses|used\s+by|call\s+chain|trace|dependency|dependents?|depends?\s+on|invoked\s+by)\b') AND (turn % 10) / 10e0 < 0.5e0 AS expands, regexp_extract_all(text, '([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?') = [] AS uncited, contains(lower(text), lower('I don''t have enough information in the retrieved context to answer this confidently.')) AS refused, length(text) BETWEEN 1 AND 2000 AS in_bounds FROM conversations WHERE text IS NOT NULL""")
def message_gates(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").where(t.isNotNull()).select("conv_id", "turn", t.rlike(ranking.TRACE).alias("m"), t, (F.col("turn") % 10 / F.lit(10.0) < ranking.TRACE_BELOW).alias("low")).select("conv_id", "turn", (F.col("m") & F.col("low")).alias("expands"), (F.size(citations.extract(t)) == 0).alias("uncited"), citations.refuses(t).alias("refused"), appdata.in_bounds(t, 1, 2000).alias("in_bounds"))


CITED = [
    ("see src/config.py:10-30", [("src/config.py", 1, 40)], True), ("see src/made_up.py:1-5", [("src/config.py", 1, 40)], False),
    ("see src/config.py:900-950", [("src/config.py", 1, 40)], False), ("in notebooks/Invoice Flagging.ipynb:1281-1380", [("notebooks/Invoice Flagging.ipynb", 1281, 1380)], True),
    ("no citation", [("a.py", 1, 5)], False), ("src/config.py:1 and src/nope.py:2", [("src/config.py", 1, 40)], False), ("a.py:1-2", [], False),
    ("README[1-100]", [("README.md", 1, 100)], True), ("other/config.js:5", [("src/config.py", 1, 40)], True), ("src/config[999]", [("src/config.py", 1, 40)], True),
    ("config.py:41", [("src/config.py", 1, 40)], False), ("config.py:40", [("src/config.py", 1, 40)], True), ("src/config.py:35-900", [("src/config.py", 1, 40)], True),
    ("src/config.py:5 at example.com:443", [("src/config.py", 1, 40)], False), ("in notebooks/Invoice Flagging.ipynb:9999", [("notebooks/Invoice Flagging.ipynb", 1281, 1380)], True),
]


@query(
    """WITH b(x) AS (VALUES (true), (false)) SELECT c.x AS has_chunks, v1.x AS valid1, r1.x AS refusal1, v2.x AS valid2, r2.x AS refusal2,
CASE WHEN NOT c.x THEN 'refused_no_context' WHEN r1.x THEN 'refused' WHEN v1.x THEN 'answered' WHEN r2.x THEN 'refused_retry' WHEN v2.x THEN 'answered_retry' ELSE 'refused_closed' END AS outcome FROM b c, b v1, b r1, b v2, b r2"""
)
def retry_outcome(spark, d):
    bits = spark.range(32).select(*((F.shiftright("id", i) % 2 == 1).alias(n) for i, n in enumerate(("has_chunks", "valid1", "refusal1", "valid2", "refusal2"))))
    return bits.withColumn("outcome", citations.outcome(*(F.col(c) for c in ("has_chunks", "valid1", "refusal1", "valid2", "refusal2"))))


@query("SELECT o_custkey AS owner, o_orderkey AS repo, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))::INT AS place FROM orders")
def repos_newest_first(spark, d):
    return appdata.newest_first(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("repo"), "place")


@query("SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def repo_status_latest(spark, d):
    return appdata.latest(table(spark, d, "events").where(F.col("user_id").isNotNull()), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("event_type").alias("status"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return appdata.cascade(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS place FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user')")
def conversation_messages(spark, d):
    rows = table(spark, d, "conversations")
    owned = rows.where("role = 'user'").select("conv_id").distinct()
    return rows.join(owned, "conv_id", "left_semi").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("SELECT sha1(text) AS chunk_id, max(doc_id) AS seq, arg_max(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY 1")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha1("text").alias("chunk_id"), F.col("doc_id").alias("seq"), "source")
    return appdata.upsert(rows, "chunk_id", "seq")


@query("WITH m AS (SELECT 'quality' AS metric, quality::DOUBLE AS score, 0.7e0 AS threshold FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE, 0.75e0 FROM labels) SELECT metric, count(score) AS n, round(avg(score), 6) AS mean, CASE WHEN count(score) = 0 THEN 'n/a' WHEN round(avg(score), 6) >= max(threshold) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m GROUP BY 1")
def eval_verdicts(spark, d):
    labels = table(spark, d, "labels")
    one = lambda c, t: labels.select(F.lit(c).alias("metric"), F.col(c).cast("double").alias("score"), F.lit(t).alias("threshold"))
    return evaluation.verdicts(one("quality", 0.7).unionByName(one("toxic", 0.75)))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def activity_by_day(spark, d):
    from lodestone.streaming.status import activity

    return activity(table(spark, d, "events"))


@query(f"""WITH {_BM25}, {_KEPT.replace("lower(split_part(d.text, ' ', 1))", "'doc'")}, run AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS running FROM kept) SELECT query_id, place::INT AS place, doc_id, file_path, round(score, 6) AS score, tokens::INT AS tokens, running::BIGINT AS running FROM run WHERE running <= 8000 OR place = 1""")
def ask_pipeline(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.lit("doc").alias("symbol_name"), F.col("text").alias("content"))
    return ask(chunks, _questions(spark, d)).withColumn("score", F.round("score", 6))


def queries() -> dict[str, Query]:
    from lodestone import queries_answer, queries_app, queries_code  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
