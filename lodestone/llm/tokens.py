"""Corpus passes of the word BPE: lexicon from word counts, encoding and decoding.

``encode_decode`` is the digest-free operator; queries derive digests from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pieces
from lodestone.llm.pieces import SPECIAL
from lodestone.llm.wordbpe import WordBPE, build_lexicon, default_tokenizer, worker_encoder
from lodestone.llm.workers import frugal

LEXICON_WORDS = 32_768


def word_counts(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: pieces as the tokenizer splits them, in UTF-8. Null texts have none, and special tokens count as words."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, None)
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for _, _, texts in pieces.runs(batch.column(0)):
                units = [u for t in texts for u in encoder.units(t)]
                found, _ = pieces.split([u for u in units if isinstance(u, str)])
                others = pa.array([p for u in units if not isinstance(u, str) for p in u], pa.binary())
                counts = pa.concat_arrays([found, others]).value_counts()
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            if sum(t.num_rows for t in held) > 1_000_000:
                held = [summed()]
                if held[0].num_rows > 500_000:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    return texts.mapInArrow(frugal(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The ``most`` most frequent words, ties by word: the bound of what is collected. Single occurrences teach nothing."""
    top = word_counts(docs, tokenizer, text_col).where(F.col("n") > 1).where(F.octet_length("word") <= 64).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(r["word"]) for r in top.toLocalIterator()]


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> bytes:
    """Transducer of the corpus's frequent split words: bounded by ``most`` words of 64 bytes."""
    bpe = WordBPE(tokenizer)
    words = sorted(w for w in frequent_words(docs, tokenizer, text_col, most) if not w.startswith(SPECIAL))
    ids, size = bpe.merge_words(words)
    ends = np.cumsum(size)
    return build_lexicon({w: ids[e - n : e].tolist() for w, e, n in zip(words, ends, size, strict=True)})


CODED = "ids array<int>, decoded string"


def encode_decode(docs: DataFrame, keep: list[str], tokenizer: str | None = None, lexicon: bytes | None = None, text_col: str = "text", digests: bool = False) -> DataFrame:
    """Columns ``keep`` with token ids and the text decoded from them.

    With ``digests`` the columns are n_tokens, ids_sha256 and decoded_sha256
    instead, made next to the ids so that these need not leave the worker. A
    null text is encoded as an empty one, which has no ids and decodes to "".
    Each row is coded by itself: repeated rows and null ids give their own rows,
    an empty table none. ``lexicon`` (from ``compile_lexicon``) changes speed
    only, never the ids. Columns kept may not be named ``_text`` or like those
    that are added.
    """
    tokenizer = tokenizer or default_tokenizer()
    if lexicon is None:
        lexicon = compile_lexicon(docs, tokenizer, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    chosen = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else CODED
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), more])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, shared.value)
        for batch in batches:
            for start, stop, texts in pieces.runs(batch.column(len(keep))):
                ids, offsets = encoder.encode(texts)
                decoded = encoder.decode_batch(ids, offsets)
                if digests:
                    made = [
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                        pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in decoded], pa.string()),
                    ]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))), decoded]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, stop - start) for i in range(len(keep))), *made], schema=pa.schema([*(pa.field(k, batch.column(i).type) for i, k in enumerate(keep)), *(pa.field(n, x.type) for n, x in zip(names, made, strict=True))]))

    return chosen.mapInArrow(frugal(run), schema)
