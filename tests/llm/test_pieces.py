"""Batch splitting and merging against the tokenizers library, on odd, random and very long texts."""

import random
import time

import numpy as np
import pytest

from lodestone.llm import pieces, sstable, tokens
from lodestone.llm.wordbpe import Encoder, Lexicon, WordBPE, build_lexicon, default_tokenizer
from test_llm import library

BITS = ["'", "'s", "'re", "'ll", "'d", "s", "t", "re", "ve", "m", "L", "É", "ß", "İ", "Ⱥ", "Σ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "1", "23", "²", "½", ".", "...", "-", "“", "”", "€", "日本", "ной", "한", "x", "<|endoftext|>", "<|", "́", "👩", "the", "ing", "\t"]


@pytest.fixture(scope="module")
def encoders():
    bpe = WordBPE(default_tokenizer())
    return library(), Encoder(bpe), sstable.LibraryEncoder(default_tokenizer())


def check(encoders, texts):
    lib, own, other = encoders
    for text, a, b in zip(texts, own.encode_batch(texts), other.encode_batch(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        same = np.frombuffer(a, "<u4").tolist() == want, np.frombuffer(b, other.kind).tolist() == want
        assert same == (True, True), text[:60]
        assert own.decode(np.frombuffer(a, "<u4")) == lib.decode(want, skip_special_tokens=False)


def test_random_texts(encoders, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(14))) for _ in range(3000)]
    check(encoders, texts)
    monkeypatch.setattr(pieces, "BATCH_POINTS", 20)
    check(encoders, texts[:200])


def test_every_character(encoders):
    check(encoders, [f"a{chr(c)}b {chr(c)} 's{chr(c)}" for a, b in pieces.SETTLED for c in range(a, min(b + 1, a + 900))])


def test_very_long_words(encoders):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshr", k=n)) for n in (191, 192, 193, 5000, 100_000)] + ["a" * 100_000, "日本" * 3000, "!" * 9000]
    began = time.time()
    check(encoders, [*words, " ".join(words)])
    assert time.time() - began < 60


def test_long_and_short_merges_agree():
    bpe, rng = WordBPE(default_tokenizer()), random.Random(3)
    words = ["".join(rng.choices("theinga", k=rng.randrange(1, 90))).encode() for _ in range(800)]
    ids, size = bpe.merge_words(words)
    ends = np.cumsum(size)
    for w, e, n in zip(words, ends, size, strict=True):
        assert ids[e - n : e].tolist() == bpe._merge_long(w).tolist()


def test_table_forgets_and_stays_exact():
    bpe = WordBPE(default_tokenizer())
    small, rng = Encoder(bpe, remember=50), random.Random(4)
    texts = [" ".join("".join(rng.choices("abcd", k=4)) for _ in range(60)) for _ in range(40)]
    whole = Encoder(bpe)
    for t in texts:
        assert small.encode_batch([t]) == whole.encode_batch([t])
        assert len(small.table.size) <= 50 + 60


def test_lexicon_shares_suffixes_and_round_trips():
    bpe = WordBPE(default_tokenizer())
    words = sorted({a + b for a in ("walk", "talk", "x", "é") for b in ("", "ing", "ed", "s")} - {""})
    entries = {w.encode(): bpe.merge_words([w.encode()])[0].tolist() for w in words}
    made = Lexicon.mapped(build_lexicon(entries))
    index = made.find([w.encode() for w in words])
    ids, size = made.outputs(index)
    assert ids.tolist() == [i for w in words for i in entries[w.encode()]] and size.tolist() == [len(entries[w.encode()]) for w in words]
    assert len(made.final) < sum(len(w) for w in words) / 2
    assert made.find([b"walkin", b"q", b"talkings"]).tolist() == [-1, -1, -1]


def test_word_counts(spark):
    rows = [(1, "The walls, the WALLS"), (2, None), (3, ""), (4, "it's <|endoftext|>the"), (5, "\U0001f469 the")]
    got = {bytes(r["word"]): r["n"] for r in tokens.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {b"the": 4, b"walls": 2, b",": 1, b"it": 1, b"'s": 1, b"\xff<|endoftext|>": 1, "\U0001f469".encode(): 1}
