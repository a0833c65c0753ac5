"""Queries along the answer path: hybrid retrieval, reranking, routing, expansion, context, answers and their citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import citations, ranking
from lodestone.plans import ask as plan
from lodestone.providers import OverlapReranker, rewritten, scored
from lodestone.queries import _BM25, _CALLS_SQL, _LOCAL, CITED, _call_chunks
from lodestone.queries_code import _WORDS, _vectors
from lodestone.registry import query
from lodestone.session import importable, saved, small, table

#: Every fourth question asks for callers, in words that match little, so that some are routed to the call graph.
_ASKED = "CASE WHEN item_id % 4 = 0 THEN concat('who calls qqqq wwww eeee ', split_part(text, ' ', 1)) ELSE text END"


def _questions(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_ASKED).alias("question"))
    # The rewriting fails for some questions: their own words are searched.
    answer = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit(" "), F.col("question"), F.lit(" call chain "))).when(F.col("query_id") % 3 == 1, F.lit("  "))
    return rows.withColumn("search", rewritten(F.col("question"), answer))


def _chunks(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    name = F.lower(F.regexp_extract("text", f"^{_LOCAL}", 0))
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")))
    return docs.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), name.alias("symbol_name"), F.lit(1).alias("start_line"), lines.alias("end_line"), F.col("text").alias("content"))


_HYBRID = f"""qs AS (SELECT item_id, {_ASKED} AS text FROM benchmark), dd AS (SELECT * FROM documents WHERE text IS NOT NULL),
{_BM25.replace('FROM benchmark', 'FROM qs').replace('FROM documents', 'FROM dd')},
{_vectors('dv', 'dd', 'doc_id', 'text')}, {_vectors('qv', 'qs', 'item_id', 'text')},
dense AS (SELECT b.key AS query_id, a.key AS doc_id, CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0e0 ELSE round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) END AS score FROM dv a, qv b),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 100),
hy AS (SELECT query_id, doc_id, a.rank AS ra, b.rank AS rb, round(coalesce(1e0 / (60 + a.rank), 0e0) + coalesce(1e0 / (60 + b.rank), 0e0), 9) AS fused FROM dr a FULL OUTER JOIN bmr b USING (query_id, doc_id)),
hyr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ra NULLS LAST, rb NULLS LAST) AS position FROM hy QUALIFY position <= 100)"""
_ABOUT = f"""ch AS (SELECT doc_id, 'docs/' || doc_id || '.txt' AS path, lower(regexp_extract(text, '^{_LOCAL}')) AS symbol, text, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS n FROM dd),
qw AS (SELECT item_id AS query_id, text AS question, list_distinct({_WORDS.format('text')}) AS asked, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_./-]+\\.[\\p{{L}}\\p{{N}}_]+|[\\p{{L}}\\p{{N}}_]{{4,}}')) AS named FROM qs),
dw AS (SELECT doc_id, path, symbol, list_distinct({_WORDS.format("path || ' ' || symbol || chr(10) || text")}) AS w FROM ch),
ov2 AS (SELECT query_id, doc_id, CASE WHEN len(asked) = 0 THEN 0e0 ELSE round(len(list_intersect(asked, w)) / len(asked)::DOUBLE, 6) END AS score,
  CASE WHEN list_contains(named, path) OR list_contains(named, split_part(path, '/', 2)) THEN 1e0 ELSE 0e0 END + CASE WHEN list_contains(named, symbol) THEN 1e0 ELSE 0e0 END AS boost FROM qw, dw),
rr AS (SELECT query_id, doc_id, score + boost AS score, row_number() OVER (PARTITION BY query_id ORDER BY score + boost DESC, doc_id) AS place FROM hyr JOIN ov2 USING (query_id, doc_id) QUALIFY place <= 20),
route AS (SELECT query_id, coalesce(r.score, 0e0) AS top, regexp_matches(CASE WHEN query_id % 3 = 0 THEN question || ' call chain' ELSE question END || ' ' || question, '(?i)\\b(?:calls?|callers?|callees?|invoke[sd]?|who\\s+uses|used\\s+by|call\\s+chain|trace|dependency|dependents?|depends?\\s+on|invoked\\s+by)\\b') AND coalesce(r.score, 0e0) < 0.5e0 AS expands FROM qw LEFT JOIN rr r USING (query_id) WHERE coalesce(r.place, 1) = 1)"""
_EXPANDED = f"""seeds AS (SELECT query_id, s.doc_id, s.qualified_id FROM rr JOIN route USING (query_id) JOIN s USING (doc_id) WHERE expands),
near AS (SELECT DISTINCT q.query_id, n.doc_id FROM seeds q JOIN (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) x ON x.a = q.qualified_id JOIN s n ON n.qualified_id = x.b WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = q.query_id AND z.doc_id = n.doc_id)),
late AS (SELECT query_id, doc_id, score, (SELECT max(place) FROM rr WHERE rr.query_id = near.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM near JOIN ov2 USING (query_id, doc_id)),
places AS (SELECT query_id, doc_id, score, place, false AS expanded FROM rr UNION ALL SELECT query_id, doc_id, score, place, true FROM late)"""
_PACKED = rf"""bl AS (SELECT query_id, doc_id, place, '### ' || path || ':1-' || n || ' (' || symbol || ')' || chr(10) || '```' || chr(10) || text || chr(10) || '```' AS block FROM places JOIN ch USING (doc_id)),
tk AS (SELECT *, len({_WORDS.format('block')}) AS tokens FROM bl), rn AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS running FROM tk),
pk AS (SELECT * FROM rn WHERE running <= 8000 OR place = 1)"""


def _fused(spark, d):
    return plan.retrieve(_chunks(spark, d), _questions(importable(spark), d))


def _kept(spark, d):
    return saved(plan.reranked(_fused(spark, d), _chunks(spark, d), _questions(spark, d)), "kept")


def _places(spark, d):
    kept, asked = _kept(spark, d), _questions(spark, d)
    return plan.expanded(kept, plan.routed(kept, asked), _chunks(spark, d), asked, _call_chunks(spark, d))


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, fused, position::INT AS position FROM hyr")
def hybrid_topk(spark, d):
    return _fused(spark, d).select("query_id", "doc_id", "fused", "position")


@query(f"WITH {_HYBRID}, {_ABOUT} SELECT query_id, doc_id, round(score, 6) AS score, place::INT AS place FROM rr")
def rerank_topk(spark, d):
    return _kept(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_HYBRID}, {_ABOUT}, w2 AS (SELECT doc_id, list_distinct({_WORDS.format('left(text, 2000)')}) AS w FROM dd) SELECT query_id, doc_id, CASE WHEN len(asked) = 0 THEN 0e0 ELSE round(len(list_intersect(asked, w)) / len(asked)::DOUBLE, 6) END AS score FROM bmr JOIN qw USING (query_id) JOIN w2 USING (doc_id) WHERE rank <= 10")
def rerank_provider(spark, d):
    """Scores by the reranker that plugs in, one question a call, of documents cut to what a hosted one reads."""
    from lodestone.operators import search

    asked = _questions(importable(spark), d)
    chunks = _chunks(spark, d)
    best = small(search.bm25_topk(chunks, asked, 10, text="content").select("query_id", "doc_id"), "best")
    rows = chunks.select("doc_id", F.substring("content", 1, 2000).alias("document")).join(best, "doc_id").join(asked, "query_id")
    return scored(rows.repartition("query_id").sortWithinPartitions("query_id"), OverlapReranker).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_HYBRID}, {_ABOUT} SELECT query_id, round(top, 6) AS top, expands FROM route")
def route_decision(spark, d):
    return plan.routed(_kept(spark, d), _questions(spark, d)).select("query_id", F.round("top", 6).alias("top"), "expands")


@query(f"{_CALLS_SQL.replace('WITH s', f'WITH {_HYBRID}, {_ABOUT}, s', 1)}, {_EXPANDED} SELECT query_id, doc_id, round(score, 6) AS score, place::INT AS place, expanded FROM places")
def expanded_rank(spark, d):
    return _places(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("place").cast("int").alias("place"), "expanded")


_TO_PLACES = f"{_CALLS_SQL.replace('WITH s', f'WITH {_HYBRID}, {_ABOUT}, s', 1)}, {_EXPANDED}, {_PACKED}"


@query(
    _TO_PLACES
    + r" SELECT query_id, count(*) AS blocks, md5(string_agg(CASE WHEN tokens > 8000 THEN array_to_string(regexp_extract_all(block, '[^\p{L}\p{N}]*[\p{L}\p{N}]+')[1:8000], '') ELSE block END, chr(10) || chr(10) ORDER BY place)) AS context_md5 FROM pk GROUP BY 1"
)
def context_blocks(spark, d):
    rows = plan.packed(saved(_places(spark, d), "places"), _chunks(spark, d))
    count = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"))
    return ranking.context_text(rows).join(count, "query_id").select("query_id", "blocks", F.md5("context").alias("context_md5"))


@query(_TO_PLACES + " SELECT q.query_id, coalesce('See ' || c.path || ':1-' || c.n || '.', '" + citations.REFUSAL.replace("'", "''") + "') AS answer, CASE WHEN c.path IS NULL THEN 'refused_no_context' ELSE 'answered' END AS outcome FROM qw q LEFT JOIN (SELECT query_id, doc_id FROM pk WHERE place = 1) p USING (query_id) LEFT JOIN ch c USING (doc_id)")
def answer_gate(spark, d):
    """The whole path, from questions to gated answers, with the model that plugs in."""
    return plan.answer(_chunks(spark, d), _questions(importable(spark), d), _call_chunks(spark, d))


@query(f"WITH {_HYBRID}, {_ABOUT} SELECT query_id, count(DISTINCT path) AS files, count(DISTINCT split_part(path, '/', 2)) AS names FROM rr JOIN ch USING (doc_id) GROUP BY 1")
def distinct_files(spark, d):
    return ranking.files_of(_kept(spark, d))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN trim(' ' || q || ' call chain ') ELSE q END AS search FROM (SELECT item_id, " + _ASKED + " AS q FROM benchmark)")
def rewrite_fallback(spark, d):
    return _questions(spark, d).select("query_id", "search")


_SAID = "CASE WHEN turn % 4 = 0 THEN 'I don''t have enough information in the retrieved context to answer this confidently. ' ELSE '' END || coalesce(text, '') || ' see src/a' || turn || '.py:' || (turn + 1) || '-' || (turn + 9) || ' and b.c:' || turn || CASE WHEN turn % 2 = 0 THEN ' end' ELSE '' END"


def _said(spark, d):
    return table(spark, d, "conversations").withColumn("answer", F.expr(_SAID.replace("''t", "\\'t")))


@query(rf"""WITH a AS (SELECT conv_id, turn, {_SAID} AS x FROM conversations), p AS (SELECT conv_id, turn, regexp_split_to_array(x, '[\w./\\-]+\.\w+:\d+(?:-\d+)?') AS t, regexp_extract_all(x, '[\w./\\-]+\.\w+:\d+(?:-\d+)?') AS c FROM a),
s AS (SELECT conv_id, turn, list_filter(flatten(list_transform(range(len(t)), lambda i: ['T' || t[i + 1], coalesce('C' || c[i + 1], 'T')])), lambda y: y NOT IN ('T')) AS s FROM p) SELECT conv_id, turn, md5(array_to_string(s, '|')) AS segments_md5, len(s)::INT AS n FROM s""")
def citation_segments(spark, d):
    parts = citations.segments(F.col("answer"))
    return _said(spark, d).select("conv_id", "turn", parts.alias("p")).select("conv_id", "turn", F.md5(F.array_join(F.transform("p", lambda x: F.concat(F.when(x["cited"], "C").otherwise("T"), x["text"])), "|")).alias("segments_md5"), F.size("p").alias("n"))


@query(f"WITH a AS (SELECT role, contains(lower({_SAID}), lower('I don''t have enough information in the retrieved context to answer this confidently.')) AS refused FROM conversations) SELECT role, count(*) AS answers, count(*) FILTER (refused) AS refusals, round(count(*) FILTER (refused) / count(*)::DOUBLE, 6) AS rate FROM a GROUP BY 1")
def refusal_rate(spark, d):
    return citations.refusal_rate(_said(spark, d).withColumn("refused", citations.refuses(F.col("answer"))), ["role"])


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CASES = ", ".join(f"({i}, {_text(a)}, [{', '.join(f'struct_pack(p := {_text(p)}, a := {x}, b := {y})' for p, x, y in c)}]::STRUCT(p VARCHAR, a INT, b INT)[])" for i, (a, c, _) in enumerate(CITED))
_BASE, _STEM = "regexp_extract({}, '[^/]*$')", r"regexp_replace(regexp_extract({}, '[^/]*$'), '\.[^.]*$', '')"


@query(
    rf"""WITH x(case_id, answer, chunks) AS (VALUES {_CASES}),
c AS (SELECT case_id, unnest(range(len(regexp_extract_all(answer, '([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?'))))::INT + 1 AS i, answer FROM x),
strict AS (SELECT case_id, i, regexp_extract_all(answer, '([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?', 1)[i] AS path, regexp_extract_all(answer, '([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?', 2)[i]::BIGINT AS f, coalesce(try_cast(regexp_extract_all(answer, '([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?', 3)[i] AS BIGINT), regexp_extract_all(answer, '([\w./\\-]+\.\w+):(\d+)(?:-(\d+))?', 2)[i]::BIGINT) AS l FROM c),
len0 AS (SELECT case_id, unnest(regexp_extract_all(answer, '\b([\w./\\-]+)\[(\d+)(?:-(\d+))?\]', 1)) AS path FROM x),
s0 AS (SELECT case_id, answer, unnest(chunks) AS c FROM x), s AS (SELECT case_id, answer, c.p AS p, c.a AS a, c.b AS b FROM s0),
spaced AS (SELECT case_id, p, string_split(p, ' ')[-1] AS tail FROM s WHERE contains(p, ' ') AND regexp_matches(answer, regexp_escape(p) || ':\d+')),
found AS (SELECT t.case_id, t.i, k, f <= b AND l >= a AS fits FROM strict t JOIN s USING (case_id), (VALUES (1), (2), (3)) v(k) WHERE CASE k WHEN 1 THEN path WHEN 2 THEN {_BASE.format('path')} ELSE {_STEM.format('path')} END IN (p, {_BASE.format('p')}, {_STEM.format('p')})),
fit AS (SELECT case_id, i, bool_or(fits) AS fits FROM found n WHERE k = (SELECT min(k) FROM found m WHERE m.case_id = n.case_id AND m.i = n.i) GROUP BY 1, 2),
ok AS (SELECT t.case_id, bool_and((EXISTS (SELECT 1 FROM s WHERE s.case_id = t.case_id AND (s.p = t.path OR {_STEM.format('s.p')} = {_STEM.format('t.path')})) OR EXISTS (SELECT 1 FROM spaced z WHERE z.case_id = t.case_id AND z.tail = t.path)) AND coalesce(fit.fits, true)) AS ok FROM strict t LEFT JOIN fit ON fit.case_id = t.case_id AND fit.i = t.i GROUP BY 1),
lo AS (SELECT t.case_id, bool_and(EXISTS (SELECT 1 FROM s WHERE s.case_id = t.case_id AND (s.p = t.path OR {_STEM.format('s.p')} = {_STEM.format('t.path')})) OR EXISTS (SELECT 1 FROM spaced z WHERE z.case_id = t.case_id AND z.tail = t.path)) AS ok FROM len0 t GROUP BY 1)
SELECT case_id, CASE WHEN len(chunks) = 0 THEN false ELSE coalesce((SELECT ok FROM ok WHERE ok.case_id = x.case_id), (SELECT ok FROM lo WHERE lo.case_id = x.case_id), EXISTS (SELECT 1 FROM spaced z WHERE z.case_id = x.case_id)) END AS valid FROM x"""
)
def citations_validate(spark, d):
    rows = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(CITED)], "case_id int, answer string, chunks array<struct<file_path:string,start_line:int,end_line:int>>")
    return citations.validate(rows).select("case_id", "valid")
