"""Re-ranking, quotas, routing and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import basename, mentions, words

KEEP, BUDGET, TRACE_BELOW = 20, 8000, 0.5
#: Fixed value: how questions about calls and dependencies are told.
TRACE = r"(?iU)\b(?:calls?|callers?|callees?|invoke[sd]?|who\s+uses|used\s+by|call\s+chain|trace|dependency|dependents?|depends?\s+on|invoked\s+by)\b"


def boosted(score: Column, question: Column, path: Column, symbol: Column) -> Column:
    """Score, plus 1 if the question names the file, plus 1 if it names the symbol."""
    named = mentions(question)
    file = F.array_contains(named, F.lower(basename(path))) | F.array_contains(named, F.lower(path))
    return score + F.when(F.coalesce(file, F.lit(False)), 1.0).otherwise(0.0) + F.when(F.coalesce(F.array_contains(named, F.lower(symbol)), F.lit(False)), 1.0).otherwise(0.0)


def cap_per_file(rows: DataFrame, keep: int = KEEP, path: str = "file_path", tie: str = "doc_id") -> DataFrame:
    """Best ``keep`` rows of a question with a quota for each file; the overflow of full files fills what is left."""
    quota = max(2, keep // 4)
    order = [F.desc("score"), F.col(tie)]
    out = rows.withColumn("in_file", F.row_number().over(Window.partitionBy("query_id", path).orderBy(*order)))
    out = out.withColumn("overflow", F.col("in_file") > quota)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("overflow", *order))).where(F.col("place") <= keep)


def confidence(kept: DataFrame) -> DataFrame:
    """(query_id, top): the score of the first kept row."""
    return kept.where("place = 1").select("query_id", F.col("score").alias("top"))


def wants_expansion(question: Column, search: Column, top: Column) -> Column:
    """A question about calls or dependencies whose best score is below the threshold."""
    return F.coalesce(F.concat_ws(" ", search, question).rlike(TRACE) & (top < TRACE_BELOW), F.lit(False))


def rerank_document(path: Column, symbol: Column, content: Column) -> Column:
    """What a reranker reads of a chunk."""
    return F.concat(path, F.lit(" "), symbol, F.lit("\n"), content)


def overlap_score(question: Column, document: Column, characters: int | None = None) -> Column:
    """Share of the question's distinct words that the document holds: the default scorer, as an expression."""
    asked = F.array_distinct(words(question))
    seen = words(document if characters is None else F.substring(document, 1, characters))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(asked, seen)) / F.size(asked), 6))


def append_expanded(kept: DataFrame, extras: DataFrame, tie: str = "doc_id") -> DataFrame:
    """Kept rows by place, then the expanded ones by their own score: place goes on after the last kept one."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    last = kept.groupBy("query_id").agg(F.max("place").alias("_last"))
    later = extras.withColumn("_n", F.row_number().over(order)).join(last, "query_id", "left").withColumn("place", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")
    columns = ["query_id", tie, "score", "place"]
    return kept.select(*columns, F.lit(False).alias("expanded")).unionByName(later.select(*columns, F.lit(True).alias("expanded")))


def block_text(path: Column, first: Column, last: Column, symbol: Column, content: Column) -> Column:
    """One chunk of the context: a heading that can be cited, and its fenced content."""
    return F.concat(F.lit("### "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(" ("), symbol, F.lit(")\n```\n"), content, F.lit("\n```"))


def first_words(text: Column, most: int) -> Column:
    """The text up to its ``most``-th run of letters and digits."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"), 0), 1, most), "")


def context_text(packed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, context) from the packed rows' block_text, in their order; a first block that is too long is cut."""
    block = F.when(F.col("tokens") > budget, first_words(F.col("block_text"), budget)).otherwise(F.col("block_text"))
    parts = packed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("text")))).alias("_parts"))
    return parts.select("query_id", F.array_join(F.transform("_parts", lambda x: x["text"]), "\n\n").alias("context"))


def files_of(rows: DataFrame, path: str = "file_path") -> DataFrame:
    """(query_id, files, names): distinct paths, and distinct names without their folders."""
    return rows.groupBy("query_id").agg(F.count_distinct(path).alias("files"), F.count_distinct(basename(F.col(path))).alias("names"))


def pack_context(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Greedy prefix by place whose tokens fit the budget; a first block that is too long is kept, cut to the budget.

    Needs query_id, place, tokens; adds running and kept_tokens.
    """
    upto = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("running", F.sum("tokens").over(upto))
    return out.where((F.col("running") <= budget) | (F.col("place") == 1)).withColumn("kept_tokens", F.least(F.col("tokens"), F.lit(budget)))
