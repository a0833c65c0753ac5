"""What plugs into the engine, and deterministic stand-ins that need no network.

A provider is made once for each task and is handed batches: plans call it
through Arrow, so a hosted model is asked for many rows at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Hosted rerankers read this many characters of a document.
RERANK_CHARACTERS = 2000


class Embedder(Protocol):
    """Dense vectors of texts, in their order; no texts give no vectors."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Sparse(Protocol):
    """Term weights of texts, in their order."""

    def embed(self, texts: Sequence[str]) -> list[dict[str, float]]: ...


class Reranker(Protocol):
    """Scores of (query, document) pairs, in their order; all pairs of a call share one query."""

    def predict(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class Chat(Protocol):
    """Text of a completion."""

    def complete(self, system: str, user: str) -> str: ...


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...


class Parser(Protocol):
    """(kind, name, first line, last line, content) of the declarations in a source, in preorder."""

    def units(self, source: str) -> list[tuple[str, str, int, int, str]]: ...


class Judge(Protocol):
    """Score of one metric, 0 to 1, for a question, an answer and its contexts."""

    def score(self, metric: str, question: str, answer: str, contexts: Sequence[str]) -> float: ...


class Places(dict):
    """Places of words by their hash; the first ``most`` words that are asked for are remembered."""

    def __init__(self, size: int, most: int = 1 << 18):
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, word: str) -> int:
        place = int(hashlib.sha1(word.encode()).hexdigest()[:8], 16) % self.size
        if len(self) < self.most:
            self[word] = place
        return place


class HashedEmbedder:
    """Counts of words hashed into ``size`` places."""

    def __init__(self, size: int = 64):
        self.size, self.places = size, Places(size)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            row = [0.0] * self.size
            for place in map(self.places.__getitem__, WORD.findall((text or "").lower())):
                row[place] += 1.0
            out.append(row)
        return out

    def embed_one(self, text: str) -> list[float]:
        return self.embed([text])[0]


class OverlapReranker:
    """Share of the query's distinct words that the document holds."""

    def predict(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        out = []
        for query, document in pairs:
            asked = set(WORD.findall(query.lower()))
            out.append(len(asked & set(WORD.findall(document.lower()))) / len(asked) if asked else 0.0)
        return out


class HostedReranker:
    """A service that ranks one query's documents and answers with (index, score) in order of score."""

    def __init__(self, rank: Callable[[str, list[str]], list[tuple[int, float]]]):
        self.rank = rank

    def predict(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        """Scores in the order of the pairs, 0 where the service names none; pairs of several queries are a caller's error."""
        if not pairs:
            return []
        if len({q for q, _ in pairs}) > 1:
            raise ValueError("the pairs of one call must share their query")
        scores = [0.0] * len(pairs)
        for index, score in self.rank(pairs[0][0], [d[:RERANK_CHARACTERS] for _, d in pairs]):
            scores[index] = float(score)
        return scores


class WordTokenizer:
    """Ids of white-space words, in order of appearance: a stand-in for a hosted vocabulary."""

    def __init__(self):
        self.words: list[str] = []
        self.ids: dict[str, int] = {}

    def encode(self, text: str) -> list[int]:
        out = []
        for w in text.split():
            if w not in self.ids:
                self.ids[w] = len(self.words)
                self.words.append(w)
            out.append(self.ids[w])
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(self.words[i] for i in ids)


def truncated(text: str, most: int, tokenizer: Tokenizer) -> str:
    """The text, or what its first ``most`` tokens decode to."""
    ids = tokenizer.encode(text)
    return text if len(ids) <= most else tokenizer.decode(ids[:most])


class ExtractiveChat:
    """Answers with the first block of the context that it is given, cited; without one it refuses."""

    HEADER = re.compile(r"^### (.+):(\d+)-(\d+) \(", re.M)

    def complete(self, system: str, user: str) -> str:
        from lodestone.operators.citations import REFUSAL

        found = self.HEADER.search(user)
        return f"See {found[1]}:{found[2]}-{found[3]}." if found else REFUSAL


def embedded(texts: Column, make: Callable[[], Embedder]) -> Column:
    """Vectors of a text column; the embedder is made once in each task."""

    held: list[Embedder] = []

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        return pd.Series(held[0].embed(batch.fillna("").tolist()))

    return run(texts)


def scored(rows: DataFrame, make: Callable[[], Reranker], query: str = "question", document: str = "document") -> DataFrame:
    """Adds ``score``. A batch is cut at changes of the query, so that each call has one query."""
    schema = rows.select("*", F.lit(0.0).alias("score")).schema

    def run(batches):
        reranker = make()
        for batch in batches:
            scores = []
            change = (batch[query] != batch[query].shift()).cumsum()
            for _, part in batch.groupby(change, sort=False):
                scores += reranker.predict(list(zip(part[query], part[document], strict=True)))
            yield batch.assign(score=scores)

    return rows.mapInPandas(run, schema)


def rewritten(question: Column, answer: Column) -> Column:
    """The rewritten question, or the question itself where the rewriting failed or is blank."""
    return F.coalesce(F.nullif(F.regexp_replace(answer, r"^\s+|\s+$", ""), F.lit("")), question)
