"""Queries of the relational layer: accounts, repositories, conversations, messages, and their storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import appdata
from lodestone.plans import ingest
from lodestone.registry import query
from lodestone.session import shared_folder, table


@query(
    """WITH k AS (SELECT DISTINCT 'u' || c_custkey % 40 || '@x.org' AS email FROM customer WHERE c_acctbal < -500),
a AS (SELECT o_orderkey AS seq, 'u' || o_custkey % 40 || '@x.org' AS email FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) AS n FROM a)
SELECT seq, email, CASE WHEN n > 1 OR email IN (SELECT email FROM k) THEN 409 ELSE 201 END AS status FROM n"""
)
def sign_up(spark, d):
    address = lambda c: F.concat(F.lit("u"), (F.col(c) % 40).cast("string"), F.lit("@x.org"))
    known = table(spark, d, "customer").where("c_acctbal < -500").select(address("c_custkey").alias("email"))
    return appdata.new_accounts(known, table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), address("o_custkey").alias("email")))


_STATES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'ingesting' WHEN 'click' THEN 'ingesting' WHEN 'purchase' THEN 'ready' ELSE 'failed' END"


@query(
    f"""WITH l AS (SELECT user_id, event_id, {_STATES} AS status, lag({_STATES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL)
SELECT user_id, event_id, status, before, coalesce(before IS NULL AND status = 'pending' OR before IN ('ready', 'failed') AND status = 'pending' OR before = 'pending' AND status = 'ingesting' OR before = 'ingesting' AND status IN ('ready', 'failed'), false) AS legal FROM l"""
)
def status_transitions(spark, d):
    log = table(spark, d, "events").where(F.col("user_id").isNotNull()).select("user_id", "event_id", "ts", F.expr(_STATES).alias("status"))
    return appdata.transitions(log, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "status", "before", "legal")


@query(
    """WITH s AS (SELECT o_orderkey AS repo_id, unnest([0, 1, 2]) AS step, CASE WHEN o_orderstatus = 'F' THEN 'no such branch' END AS e FROM orders)
SELECT repo_id, step::INT AS step, CASE step WHEN 0 THEN 'pending' WHEN 1 THEN 'ingesting' ELSE CASE WHEN e IS NULL THEN 'ready' ELSE 'failed' END END AS status, CASE WHEN step = 2 THEN e END AS error FROM s"""
)
def status_log(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("repo_id"), F.col("o_orderdate").alias("began"), F.col("o_orderdate").alias("ended"), F.when(F.col("o_orderstatus") == "F", "no such branch").alias("error"))
    return appdata.status_log(runs, "repo_id", "began", "ended", "error").select("repo_id", "step", "status", "error")


@query(
    """WITH r AS (SELECT l_orderkey AS asked, l_linenumber AS line, l_orderkey - l_linenumber % 2 AS repo_id, o_custkey AS user_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT asked, line, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.repo_id AND o.o_custkey = r.user_id) THEN 201 ELSE 404 END AS status FROM r"""
)
def conversation_create(spark, d):
    """A conversation for each line, half of them asking for a neighbour's repository."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("repo_id"), F.col("o_custkey").alias("user_id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asked"), F.col("l_linenumber").alias("line"))
    own = lines.join(orders.withColumnRenamed("repo_id", "asked"), "asked").withColumn("repo_id", F.col("asked") - F.col("line") % 2)
    return appdata.new_conversation(own, orders).select("asked", "line", "status")


@query("SELECT l_orderkey AS repo_id, l_linenumber AS conv_id, 'all' AS filter FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT l_orderkey, l_linenumber, 'one' FROM lineitem WHERE l_suppkey = 3 AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_suppkey = 3)")
def conversation_list(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("repo_id"), F.col("l_linenumber").alias("conv_id"))
    one = appdata.conversations_of(rows, 3).agg(F.min("repo_id")).first()[0]
    pick = lambda df, kind: df.select("repo_id", "conv_id", F.lit(kind).alias("filter"))
    return pick(appdata.conversations_of(rows, 3), "all").unionByName(pick(appdata.conversations_of(rows, 3, one), "one"))


@query(
    f"""WITH st AS (SELECT user_id AS repo_id, arg_max({_STATES}, (ts, event_id)) AS status FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT c_custkey AS conv_id, CASE WHEN c_acctbal < 0 THEN 404 WHEN status IS NULL THEN 404 WHEN status <> 'ready' THEN 409 ELSE 200 END AS code FROM customer LEFT JOIN st ON repo_id = c_custkey"""
)
def chat_gate(spark, d):
    events = table(spark, d, "events").where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("repo_id"), "ts", "event_id", F.expr(_STATES).alias("status"))
    last = appdata.latest(events, "repo_id", ["ts", "event_id"], "status").select("repo_id", "status")
    asked = table(spark, d, "customer").join(last, F.col("repo_id") == F.col("c_custkey"), "left")
    return asked.select(F.col("c_custkey").alias("conv_id"), appdata.chat_gate(F.col("c_acctbal") >= 0, F.col("repo_id").isNotNull(), F.col("status")).alias("code"))


_TURN = "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"


@query(f"WITH t AS ({_TURN}), d AS (SELECT * FROM t WHERE answer IS NOT NULL) SELECT conv_id, turn, 0 AS seq, 'user' AS role, md5(question) AS text_md5, false AS refused FROM d UNION ALL SELECT conv_id, turn, 1, 'assistant', md5(answer), contains(lower(answer), 'enough information') FROM d")
def persist_pair(spark, d):
    rows = table(spark, d, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(said, ["conv_id", "turn"], "left").withColumn("key", F.struct("conv_id", "turn")).withColumn("refused", F.coalesce(F.lower("answer").contains("enough information"), F.lit(False)))
    return appdata.exchange(pairs, "key").select("key.conv_id", "key.turn", "seq", "role", F.md5("text").alias("text_md5"), "refused")


@query("SELECT o_custkey AS repo_id, max(o_orderkey) AS conv_id FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey) GROUP BY 1")
def resume_latest(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), "o_orderdate", F.col("o_orderkey").alias("conv_id"))
    return appdata.latest(rows, "repo_id", ["o_orderdate", "conv_id"]).select("repo_id", "conv_id")


@query("""SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: {"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' || chr(10) || chr(10) AS frame FROM conversations""")
def event_frames(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", appdata.event_frame(F.col("role"), F.struct("conv_id", "turn", "role")).alias("frame"))


@query("""SELECT conv_id, turn, role AS role_back FROM conversations""")
def event_frames_back(spark, d):
    """Frames read again: the body as JSON."""
    body = F.regexp_extract("frame", "(?m)^data: (.*)$", 1)
    rows = table(spark, d, "conversations").select(appdata.event_frame(F.col("role"), F.struct("conv_id", "turn", "role")).alias("frame"))
    return rows.select(F.from_json(body, "conv_id long, turn long, role string").alias("b")).select("b.conv_id", "b.turn", F.col("b.role").alias("role_back"))


@query("SELECT event_id, (ts + INTERVAL 7 DAY)::TIMESTAMP AS expires FROM events")
def session_expiry(spark, d):
    return table(spark, d, "events").select("event_id", appdata.expiry(F.col("ts")).cast("timestamp_ntz").alias("expires"))


@query(r"SELECT page_id, 'repo_' || regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS collection, regexp_extract(regexp_replace(url || '//', '/+$', ''), '[^/]*$') AS display FROM pages")
def repo_names(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", appdata.collection_name(url).alias("collection"), appdata.display_name(F.concat(url, F.lit("//"))).alias("display"))


@query("SELECT c_custkey, coalesce(c_mktsegment, 'none') AS c_mktsegment, 'free' AS plan, 0 AS repos FROM customer")
def with_defaults(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return appdata.with_defaults(rows, {"c_mktsegment": "none", "plan": "free", "repos": 0})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def point_lookup(spark, d):
    return ingest.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT DISTINCT source, n_chars % 100 AS start_line, n_chars % 100 + 10 AS end_line FROM documents")
def dedup_spans(spark, d):
    start = F.col("n_chars") % 100
    return table(spark, d, "documents").select("source", start.alias("start_line"), (start + 10).alias("end_line")).dropDuplicates(["source", "start_line", "end_line"])


@query("SELECT c_mktsegment AS email, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def first_by_email(spark, d):
    return appdata.first_of(table(spark, d, "customer").select(F.col("c_mktsegment").alias("email"), "c_custkey"), "email", ["c_custkey"])


@query("SELECT o_orderkey AS repo_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total FROM orders")
def relational_log(spark, d):
    """Rows inserted and some updated, by a version with one more column; the log gives the last version of each."""
    folder = f"{shared_folder(spark)}/repos-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders")
    appdata.append(orders.select(F.col("o_orderkey").alias("repo_id"), F.lit(1).alias("seq"), F.lit("pending").alias("status")), folder)
    appdata.append(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("repo_id"), F.lit(2).alias("seq"), F.lit("failed").alias("status"), F.col("o_totalprice").alias("total")), folder)
    return appdata.current(spark, folder, "repo_id", "seq").select("repo_id", "status", "total")


@query("SELECT doc_id % 3 AS repo, doc_id, sha1(text) AS chunk_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 1")
def collection_overwrite(spark, d):
    """Two repositories saved, one of them twice: the second replaces the first, and reading one prunes the other."""
    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id"), F.sha1("text").alias("chunk_id"))
    ingest.save_chunks(rows.where("doc_id % 3 = 2"), folder, "r2")
    ingest.save_chunks(rows.where("doc_id % 3 = 0"), folder, "r1")
    ingest.save_chunks(rows.where("doc_id % 3 = 1"), folder, "r1")
    return ingest.load_chunks(spark, folder, "r1").select((F.col("doc_id") % 3).alias("repo"), "doc_id", "chunk_id")
