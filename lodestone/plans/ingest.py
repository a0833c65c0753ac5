"""A folder of sources to chunks, call sites and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.sources import files


COLUMNS = ["chunk_id", "file_path", "symbol_name", "symbol_type", "language", "start_line", "end_line", "content", "imports"]


def chunk_files(sources: DataFrame, strategy: str = "syntax", most: int = chunking.MOST_TOKENS) -> DataFrame:
    """Chunks of (file_path, language, source_text), no larger than ``most`` tokens, with their calls and the text to embed.

    ``syntax``: declarations, and windows of the files without any. ``semantic``:
    spans between changes of meaning, for all files.
    """
    if strategy == "semantic":
        every = chunking.semantic_chunks(sources).join(sources.select("file_path", "language"), "file_path").select(*COLUMNS)
    elif strategy == "syntax":
        units = chunking.syntax_units(sources)
        windows = chunking.fixed_windows(sources.join(units.select("file_path").distinct(), "file_path", "left_anti"))
        windows = windows.withColumn("imports", chunking.imports(F.col("content"))).withColumn("language", F.lit("text"))
        every = units.select(*COLUMNS).unionByName(windows.select(*COLUMNS))
    else:
        raise ValueError(f"no such strategy: {strategy}")
    every = every.withColumn("calls", chunking.calls(F.col("content")))
    whole = chunking.split_oversized(every, most)
    return whole.withColumn("embedding_text", chunking.embedding_text(F.col("file_path"), F.col("symbol_type"), F.col("symbol_name"), F.col("content")))


def chunk_tree(spark: SparkSession, root: str, strategy: str = "syntax") -> DataFrame:
    """Chunks of every indexable file below a folder."""
    sources = files.read_sources(files.discover(spark, root), root).where(F.col("source_text").isNotNull())
    return chunk_files(sources, strategy)


def counters(scanned: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files scanned, files that gave no chunk, chunks."""
    made = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("made"))
    return scanned.join(made, "file_path", "left").agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if(F.col("made").isNull()).alias("files_skipped"), F.coalesce(F.sum("made"), F.lit(0)).alias("total_chunks"))


def save_chunks(chunks: DataFrame, root: str, repo_id: str) -> None:
    """Replace one repository's partition."""
    chunks.withColumn("repo_id", F.lit(repo_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(root)


def load_chunks(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """One repository's chunks: only its partition is read."""
    return spark.read.parquet(root).where(F.col("repo_id") == repo_id)


def lookup(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows with one of the ids, each once whatever is repeated in ``ids``."""
    return chunks.join(ids.select(key), key, "left_semi")
