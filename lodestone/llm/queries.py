"""Queries over the driver's tables, one for each operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, langid, licenses, media, mixing, ngram_join, sharding, sstable, tokens, warc
from lodestone.llm.wordbpe import default_tokenizer
from lodestone.session import importable, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have Jaccard similarity 0.85 or more."""
    return ngram_join.near_duplicate_components(table(importable(spark), sf_dir, "documents"), words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as WAVE samples, sniffed, validated and read back."""
    stored = media.store_texts(table(importable(spark), sf_dir, "documents"))
    return media.media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "detected", "embedded")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(importable(spark), sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents that bring every source's words to its target."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in documents, with coverage and spans."""
    return licenses.scan_licenses(table(importable(spark), sf_dir, "documents"), ["doc_id"])


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records in seekable bundles and read back."""
    index = warc.write_archives(warc.plan_records(table(importable(spark), sf_dir, "pages"), least_payload=0))
    return warc.read_archives(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids written as sorted-string-table shards and read back."""
    return sstable.read_tokens(sstable.write_tokens(table(importable(spark), sf_dir, "documents"), default_tokenizer(), end_id=1))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every 20th."""
    rows = table(importable(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return tokens.encode_decode(table(importable(spark), sf_dir, "documents"), ["doc_id"], default_tokenizer(), digests=True)


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards, each with the mixture of sources of the whole."""
    return sharding.interleaved_shards(table(spark, sf_dir, "documents"), shards=8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard_join, op2_media_columns, op3_language_id, op4_source_mix, op5_license_scan, op6_warc_bundles, op7_token_shards, op8_nearest_neighbours, op9_bpe_codec, op10_stratified_shards)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
arcs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN arcs b ON b.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) m ON m.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


_LITTLE = "printf('%02X%02X%02X%02X', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"

#: The stored file in hexadecimal: a RIFF header that depends on the payload's size alone, then text and padding.
OP2_SQL = f"""
WITH t9 AS (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {0xEDB88320}::BIGINT) ELSE c >> 1 END, n::BIGINT) AS v FROM range(256) t(n)),
crc AS (SELECT list(v ORDER BY n) AS t FROM t9),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, length(x) // 2 AS n, x || repeat('FF', CASE WHEN x = '' THEN 576 ELSE (576 - (length(x) // 2) % 576) % 576 END) AS x FROM b),
s AS (SELECT doc_id, n, (length(x) // 2)::BIGINT AS size, x, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS v FROM p),
m AS (SELECT *, unhex('52494646' || {_LITTLE.format('(size + 36)')} || '57415645666D7420100000000100010040' || '1F0000401F000001000800' || '64617461' || {_LITTLE.format('size')} || x) AS media FROM s)
SELECT doc_id, n::BIGINT AS n_bytes, size AS payload_bytes, sha256(unhex(x)) AS payload_sha256,
  xor(list_reduce(v[size - 31:], lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS tail_crc32,
  size + 44 AS media_bytes, sha256(media) AS media_sha256,
  'audio/wav;rate=8000;channels=1;bits=8;frames=' || size || ';mean=' || printf('%.6f', list_sum(v)::DOUBLE / size) || ';rms=' || printf('%.6f', sqrt(list_sum(list_transform(v, lambda y: (y - 128) * (y - 128)))::DOUBLE / size)) || ';crossings=' || list_sum(list_transform(range(1, size), lambda i: ((v[i] < 128) <> (v[i + 1] < 128))::INT)) AS feature,
  'application/octet-stream' AS declared, 'audio/wav' AS detected, 0 AS embedded FROM m, crc
"""

#: Base 32 of a SHA-1: each 5 bytes are 8 digits of 5 bits.
OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x, min(page_id) OVER (PARTITION BY sha1(b)) AS f FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 8 * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d
"""

#: The CRC's table follows from its polynomial; the sum goes over the text's bytes.
OP10_SQL = f"""
WITH t9 AS (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {0xEDB88320}::BIGINT) ELSE c >> 1 END, n::BIGINT) AS v FROM range(256) t(n)),
crc AS (SELECT list(v ORDER BY n) AS t FROM t9),
b AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x, md5('shard:' || coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
s AS (SELECT doc_id, source, (length(x) // 2 + 1)::BIGINT AS size, ('0x' || substr(m, 1, 8))::BIGINT AS h,
  CASE WHEN x = '' THEN 0 ELSE xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) END AS text_crc32 FROM b, crc),
f AS (SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32) - 1)::DOUBLE + (('0x' || substr(md5('shard-source:' || coalesce('+' || source, '')), 1, 8))::BIGINT::DOUBLE + 0.5e0) / 4294967296e0) / (count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, doc_id, text_crc32) - 1 AS position, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((position * 8) // n)::INT AS shard, (position - (((position * 8) // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, position FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_media_columns": OP2_SQL, "op6_warc_bundles": OP6_SQL, "op10_stratified_shards": OP10_SQL}
