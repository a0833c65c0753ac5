"""The relational layer: repositories, conversations, messages and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the addresses of repositories that are taken.
REPO_URL = r"^https?://(?:www\.)?github\.com/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+/?$"


def normal_url(url: Column) -> Column:
    """Stripped, without slashes at the end, a bare host given its scheme."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    return F.when(bare.startswith("github.com/"), F.concat(F.lit("https://"), bare)).otherwise(bare)


def valid_url(url: Column) -> Column:
    return F.coalesce(F.length(url).between(1, 500) & normal_url(url).rlike(REPO_URL), F.lit(False))


def in_bounds(text: Column, least: int, most: int) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def display_name(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def collection_name(name: Column) -> Column:
    return F.concat(F.lit("repo_"), F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"))


def newest_first(rows: DataFrame, owner: str, created: str, key: str) -> DataFrame:
    """Adds place: 1 for the owner's newest row."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(created), F.desc(key))))


def latest(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Last row of each key by ``order``: an aggregate, so a hot key is combined before the shuffle."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("_last")).select(key, *(F.col(f"_last.{v}") for v in (*order, *values)))


def upsert(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write of each key wins."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    return latest(rows, key, [seq], *rest)


def new_accounts(known: DataFrame, asked: DataFrame, email: str = "email") -> DataFrame:
    """Sign-ups with their outcome: 201, or 409 where the address is taken; of several for one address the first by seq gets it."""
    first = Window.partitionBy(email).orderBy("seq")
    tagged = asked.withColumn("_n", F.row_number().over(first)).join(known.select(F.col(email).alias("_known")).distinct(), F.col(email) == F.col("_known"), "left")
    return tagged.withColumn("status", F.when((F.col("_n") > 1) | F.col("_known").isNotNull(), 409).otherwise(201)).drop("_n", "_known")


#: The states of a repository, and which may follow which.
FOLLOWS = {None: ["pending"], "pending": ["ingesting"], "ingesting": ["ready", "failed"], "ready": ["pending"], "failed": ["pending"]}


def transitions(log: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Adds ``before``, the state that the log had, and ``legal``, whether this one may follow it."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    legal = F.lit(False)
    for state, after in FOLLOWS.items():
        legal = legal | (F.col("before").eqNullSafe(F.lit(state)) & F.col(status).isin(after))
    return log.withColumn("before", before).withColumn("legal", F.coalesce(legal, F.lit(False)))


def status_log(runs: DataFrame, key: str, began: str, ended: str, error: str) -> DataFrame:
    """(key, at, step, status, error) of ingestion runs: pending, ingesting, then ready, or failed with its message."""
    failed = F.col(error).isNotNull()
    step = lambda n, status, at, message: F.struct(F.lit(n).alias("step"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), F.col(at).alias("at"), message.alias("error"))
    none = F.lit(None).cast("string")
    last = F.when(failed, "failed").otherwise("ready")
    return runs.select(key, F.explode(F.array(step(0, "pending", began, none), step(1, "ingesting", began, none), step(2, last, ended, F.col(error)))).alias("_s")).select(key, "_s.*")


def new_conversation(asked: DataFrame, repos: DataFrame) -> DataFrame:
    """Requests (user_id, repo_id) with 201, or 404 where the repository isn't the user's."""
    owned = repos.select("repo_id", F.col("user_id").alias("_owner"))
    return asked.join(owned, "repo_id", "left").withColumn("status", F.when(F.col("_owner").eqNullSafe(F.col("user_id")) & F.col("user_id").isNotNull(), 201).otherwise(404)).drop("_owner")


def conversations_of(conversations: DataFrame, user, repo=None) -> DataFrame:
    """A user's conversations, of one repository if it is given."""
    own = conversations.where(F.col("user_id") == user)
    return own if repo is None else own.where(F.col("repo_id") == repo)


def exchange(answers: DataFrame, key: str = "conv_id") -> DataFrame:
    """The two messages of every answered question, the question first; a failed answer leaves neither."""
    done = answers.where(F.col("answer").isNotNull())
    pair = F.array(F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(False).alias("refused")), F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.col("refused").alias("refused")))
    return done.select(key, F.explode(pair).alias("_m")).select(key, "_m.*")


def event_frame(kind: Column, body: Column) -> Column:
    """A server-sent event: its kind, and its body as JSON."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(body), F.lit("\n\n"))


def expiry(issued: Column, days: int = 7) -> Column:
    """When a session that began then ends."""
    return issued + F.make_dt_interval(F.lit(days))


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key, the first by ``order``: an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")).select(key, "_first.*")


def append(rows: DataFrame, folder: str) -> None:
    """Insert rows, or new versions of rows: a table of the application is a log, read by ``current``."""
    rows.write.mode("append").parquet(folder)


def current(spark, folder: str, key: str, seq: str) -> DataFrame:
    """The last version of every row of a log, whatever columns older versions lack."""
    return upsert(spark.read.option("mergeSchema", "true").parquet(folder), key, seq)


def cascade(children: DataFrame, parents_gone: DataFrame, key: str) -> DataFrame:
    """Rows that stay when their parents are deleted."""
    return children.join(parents_gone.select(key).distinct(), key, "left_anti")


def chat_gate(owned: Column, exists: Column, status: Column) -> Column:
    return F.when(~owned, 404).when(~exists, 404).when(status != "ready", 409).otherwise(200)


def with_defaults(rows: DataFrame, columns: dict) -> DataFrame:
    """Add the columns that older rows lack, filled with their defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in columns.items()})
