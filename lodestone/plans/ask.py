"""Questions to answers, as one lazy plan for a whole batch of questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions.text import basename, stem, words
from lodestone.operators import callgraph, citations, ranking, search
from lodestone.providers import Chat, ExtractiveChat, HashedEmbedder, embedded, scored
from lodestone.session import saved, small

SYSTEM = "Answer from the context alone and cite path:first-last."


def retrieve(chunks: DataFrame, questions: DataFrame, candidates: int = 100, second: str = "vector", embedder: Callable = HashedEmbedder) -> DataFrame:
    """Fused rankings (query_id, doc_id, fused, position) of BM25 and of vectors, or of BM25 and term overlap."""
    if second == "overlap":
        return search.fuse(*search.lexical_lists(chunks, questions, candidates, "content"), most=candidates)
    lexical = search.bm25_topk(chunks, questions, candidates, text="content")
    vectors = chunks.select("doc_id", embedded(F.col("content"), embedder).alias("v"))
    asked = questions.select("query_id", embedded(F.col("question"), embedder).alias("v"))
    # The dense list leads: its order breaks ties.
    return search.fuse(search.cosine_topk(vectors, asked, candidates), lexical, most=candidates)


def ask(chunks: DataFrame, questions: DataFrame, candidates: int = 100, keep: int = ranking.KEEP, budget: int = ranking.BUDGET) -> DataFrame:
    """Context rows (query_id, place, doc_id, file_path, score, tokens, running) of every question.

    ``chunks``: doc_id, file_path, symbol_name, content. ``questions``:
    query_id, question. The text is joined back only for rows that are kept.
    """
    named = questions.select("query_id", "question")
    fused = retrieve(chunks, named, candidates, "overlap")
    about = chunks.join(small(fused, "fused"), "doc_id").select("query_id", "doc_id", "fused", "file_path", "symbol_name", F.size(words(F.col("content"))).alias("tokens"))
    rows = about.join(named, "query_id")
    rows = rows.withColumn("score", ranking.boosted(F.col("fused"), F.col("question"), F.col("file_path"), F.col("symbol_name")))
    kept = ranking.cap_per_file(rows, keep)
    return ranking.pack_context(kept, budget).select("query_id", "place", "doc_id", "file_path", "score", "tokens", "running")


def reranked(fused: DataFrame, chunks: DataFrame, questions: DataFrame, keep: int = ranking.KEEP, reranker: Callable | None = None) -> DataFrame:
    """(query_id, doc_id, score, place, file_path): candidates by reranker and exact mentions, with a quota for each file."""
    # The candidates go to the chunks, whose texts aren't shuffled for them.
    rows = chunks.select("doc_id", "file_path", "symbol_name", "content").join(small(fused.select("query_id", "doc_id"), "fused"), "doc_id").join(F.broadcast(questions.select("query_id", "question")), "query_id")
    rows = rows.withColumn("document", ranking.rerank_document(F.col("file_path"), F.col("symbol_name"), F.col("content")))
    if reranker is None:
        rows = rows.withColumn("score", ranking.overlap_score(F.col("question"), F.col("document")))
    else:
        # Rows of a question follow each other, so that one call has one question.
        rows = scored(rows.repartition("query_id").sortWithinPartitions("query_id"), reranker)
    rows = rows.withColumn("score", ranking.boosted(F.col("score"), F.col("question"), F.col("file_path"), F.col("symbol_name")))
    return ranking.cap_per_file(rows.select("query_id", "doc_id", "score", "file_path"), keep)


def routed(kept: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, top, expands): the best score of each question, and whether its call graph is asked."""
    top = ranking.confidence(kept)
    return questions.join(top, "query_id", "left").select("query_id", F.coalesce("top", F.lit(0.0)).alias("top"), ranking.wants_expansion(F.col("question"), F.coalesce(F.col("search"), F.col("question")), F.coalesce("top", F.lit(0.0))).alias("expands"))


def expanded(kept: DataFrame, route: DataFrame, chunks: DataFrame, questions: DataFrame, calls: DataFrame) -> DataFrame:
    """Kept rows, then what the call graph adds for the questions that are routed there, by its own score.

    ``calls``: chunk_id (a doc_id), seq, file_path, symbol_name and calls of the chunks.
    """
    seeds = kept.join(route.where("expands").select("query_id"), "query_id", "left_semi").select("query_id", F.col("doc_id").alias("chunk_id"))
    near = callgraph.neighbours(seeds, callgraph.symbols(calls), callgraph.call_sites(calls)).withColumnRenamed("chunk_id", "doc_id")
    document = ranking.rerank_document(F.col("file_path"), F.col("symbol_name"), F.col("content"))
    asked = questions.join(F.broadcast(route.where("expands").select("query_id")), "query_id", "left_semi")
    return ranking.append_expanded(kept, search.overlap_of(near, chunks.select("doc_id", words(document).alias("w")), asked))


def packed(places: DataFrame, chunks: DataFrame, budget: int = ranking.BUDGET) -> DataFrame:
    """Adds path, lines, block_text, tokens and the running sum to the rows that fit the budget. Chunks need start_line and end_line.

    Places count from 1 without gaps. Texts join the rows that fit, not all that
    were found: a block has a token at least, for it states its lines, unless a
    part of it is null, so that later places can't fit.
    """
    parts = ["file_path", "start_line", "end_line", "symbol_name", "content"]
    block = ranking.block_text(*map(F.col, parts))
    blank = chunks.where(reduce(or_, (F.col(c).isNull() for c in parts))).count()
    near = saved(places.where(F.col("place") <= budget + 1 + blank), "near")
    # Written, since a join would count the words again for each of a document's places.
    tokens = saved(chunks.join(small(near.select("doc_id").distinct(), "ids"), "doc_id", "left_semi").select("doc_id", F.size(words(block)).alias("tokens")), "tokens")
    rows = small(ranking.pack_context(near.join(tokens, "doc_id"), budget), "packed")
    return chunks.select("doc_id", "file_path", "start_line", "end_line", block.alias("block_text")).join(rows, "doc_id")


def _names(path: Column) -> Column:
    """What a citation may call a file: its path, its name, its stem."""
    return F.array(path, basename(path), stem(basename(path)))


def cited(answers: DataFrame, places: DataFrame, chunks: DataFrame, answer: str) -> DataFrame:
    """(query_id, chunks): the spans among each question's places that its answer may cite; no other bears on ``citations.validate``.

    Of all places only those of files that some answer names are met.
    """
    found = F.concat(citations.extract(F.col(answer), citations.STRICT), citations.extract(F.col(answer), citations.LENIENT))
    said = small(answers.where(F.col(answer).isNotNull()).select("query_id", F.col(answer).alias("_said"), F.array_distinct(F.flatten(F.transform(found, lambda x: _names(x["path"])))).alias("_keys")), "said")
    keys = small(said.select(F.explode("_keys").alias("_key")).distinct(), "keys")
    spans = chunks.select("doc_id", "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    named = chunks.select("doc_id", F.explode(_names(F.col("file_path"))).alias("_key")).join(keys, "_key", "left_semi").select("doc_id")
    # Paths with blanks may be cited as they are, which no key tells.
    ids = small(named.unionByName(chunks.where(F.col("file_path").contains(" ")).select("doc_id")).distinct(), "ids")
    rows = places.select("query_id", "doc_id").join(small(spans.join(ids, "doc_id", "left_semi"), "spans"), "doc_id").join(said, "query_id")
    rows = rows.where(F.arrays_overlap("_keys", _names(F.col("file_path"))) | F.col("file_path").contains(" ") & F.contains("_said", "file_path"))
    return rows.groupBy("query_id").agg(F.collect_list(F.struct("file_path", "start_line", "end_line")).alias("chunks"))


def answered(places: DataFrame, chunks: DataFrame, questions: DataFrame, budget: int = ranking.BUDGET, chat: Callable[[], Chat] = ExtractiveChat) -> DataFrame:
    """(query_id, answer, outcome): one completion, one more where its citations fail, then a refusal.

    Citations are held against all rows that were found, packed or not.
    Questions without any row are refused and no model is asked.
    """
    context = ranking.context_text(packed(places, chunks, budget), budget)
    rows = questions.select("query_id", "question").join(context, "query_id", "left")

    def completed(asked: DataFrame, prompt: Column, name: str) -> DataFrame:
        """Adds the model's answers; null prompts ask nothing. Written, so that no prompt is sent twice."""
        rows = asked.withColumn("_prompt", prompt)
        schema = StructType([*asked.schema.fields, StructField(name, StringType())])

        def run(batches):
            model = chat()
            for batch in batches:
                said = [None if p is None else (model.complete(SYSTEM, p) or "").strip() for p in batch.column("_prompt").to_pylist()]
                columns = batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string())], names=[*batch.schema.names[:-1], name])

        return saved(rows.mapInArrow(run, schema), name)

    def held(rows: DataFrame, answer: str, valid: str) -> DataFrame:
        rows = rows.join(cited(rows, places, chunks, answer), "query_id", "left")
        return citations.validate(rows, answer).withColumn(valid, F.col("valid")).drop("valid", "step", "chunks")

    prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nRetrieved context:\n"), F.col("context"))
    rows = saved(held(completed(rows, prompt, "first"), "first", "valid1"), "gate")
    refusal1 = citations.refuses(F.col("first"))
    # All files that were found are listed for the questions alone that are asked again.
    failed = F.col("context").isNotNull() & ~refusal1 & ~F.col("valid1")
    again = places.select("query_id", "doc_id").join(small(rows.where(failed).select("query_id"), "failed"), "query_id", "left_semi")
    files = again.join(chunks.select("doc_id", "file_path"), "doc_id").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("file_path")), ", ").alias("allowed"))
    rows = completed(rows.join(files, "query_id", "left"), F.when(failed, F.concat(prompt, F.lit("\n\nCite only: "), F.col("allowed"))), "second")
    rows = held(rows, "second", "valid2")
    result = citations.outcome(F.col("context").isNotNull(), F.col("valid1"), refusal1, F.col("valid2"), citations.refuses(F.col("second")))
    rows = rows.withColumn("outcome", result)
    text = F.when(F.col("outcome").isin("answered", "refused"), F.col("first")).when(F.col("outcome").isin("answered_retry", "refused_retry"), F.col("second")).otherwise(citations.REFUSAL)
    return rows.select("query_id", text.alias("answer"), "outcome")


def answer(chunks: DataFrame, questions: DataFrame, calls: DataFrame, chat: Callable[[], Chat] = ExtractiveChat) -> DataFrame:
    """The whole path for a batch of questions: retrieve, rerank, route, expand, pack, complete and gate.

    Rankings are written between the steps, since several later ones read them.
    """
    kept = saved(reranked(retrieve(chunks, questions), chunks, questions), "kept")
    places = saved(expanded(kept, saved(routed(kept, questions), "route"), chunks, questions, calls), "places")
    return answered(places, chunks, questions, chat=chat)
