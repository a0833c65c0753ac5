"""Training-corpus pipeline: language, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; ``run`` writes every stage's rows as Parquet in the shared
folder and rereads them, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, mixing, ngram_join, tokens
from lodestone.llm.storage import materialise
from lodestone.llm.wordbpe import default_tokenizer
from lodestone.session import importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from all their labels."""
    importable(spark)
    return langid.accepted(docs.select(*COLUMNS), langid.train(docs))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (5-word shingles, similarity 0.8)."""
    importable(spark)
    return ngram_join.without_near_duplicates(docs.select(*COLUMNS), words=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text decoded from them, of every row of the mix."""
    importable(spark)
    return tokens.encode_decode(docs, ["doc_id", "lang", "source"], default_tokenizer(), digests=True)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", duplicates_stage),
    ("source_mix", mixing_stage),
    ("bpe_codec", tokens_stage),
]

#: The classifier and the tokenizer can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
