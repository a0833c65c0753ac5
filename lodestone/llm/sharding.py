"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the
fractional rank ``(rank - 1 + u) / rows of the source`` spreads every source
evenly over (0, 1). ``u``, between 0 and 1, is a hash of the source: with one
for all, sources of a single row would meet in the middle. Sorted by it, any run of rows has the mixture of the
whole, and cutting the order into equal runs gives shards whose row counts
differ by one at most. Both orders are ranked range by range, so neither a hot
source nor many small ones nor the global order are ever in one task.

DataFrame functions only; nothing is collected but the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.ranks import ranked, with_row
from lodestone.llm.storage import materialise


def hash_32(seed: str, value: Column) -> Column:
    """The first 32 bits of the md5 of seed and value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), value)), 1, 8), 16, 10).cast("long")


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: str = "shard", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, position, grown_shard) of every row.

    Law ``rows``: counts of the shards differ by one at most, and ``grown_shard``
    is null (a changed shard count cuts anew). ``size`` is the text's bytes in
    UTF-8 plus 1, a null text counting none; its CRC-32 is then that of no
    bytes, 0. Null sources are one source; null ids sort last; repeated rows are
    separate rows. Equal texts are not held together: a group may hold more rows
    than a shard may. Other columns are ignored. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = base.withColumn("h", hash_32(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = with_row(base, "shard-rows")
    last = lambda *names: [F.col(n).asc_nulls_last() for n in names]
    rows = ranked(base, last("source", "h", "doc_id", "text_crc32", "row"), "by-source")
    sources = materialise(rows.groupBy("source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("rows")), "shard-sources")
    rows = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "first", "rows")
    offset = (hash_32(seed + "-source", F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))).cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))
    fraction = ((F.col("rank") - F.col("first")).cast("double") + offset) / F.col("rows").cast("double")
    rows = materialise(rows.select("doc_id", "source", "size", "text_crc32", "row", fraction.alias("fraction")), "fractions")
    total = max(1, rows.count())
    placed = ranked(rows, last("fraction", "source", "doc_id", "text_crc32", "row"), "by-fraction")
    placed = placed.withColumn("total", F.lit(total)).withColumn("position", F.col("rank") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((position * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).cast("long").alias("slot"), "position", F.lit(None).cast("int").alias("grown_shard"))
