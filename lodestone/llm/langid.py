"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all labelled texts are summed per (language, feature) by Spark; the
matrix of log-probabilities (2**bits x languages, bounded) is broadcast, and
batches of texts are scored as sparse rows in numpy: the features of all texts
are gathered from the matrix at once and summed text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.workers import frugal, give_back

BITS = 15
ORDERS = (1, 2, 3)
#: Code points that are scored together.
POINTS = 1 << 19
#: The most entries of the matrix that is broadcast: 2**24 doubles, 128 MB.
MATRIX = 1 << 24
LETTER = r"\p{L}"
_PRIMES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, lower-cased, each between blanks, one after the other; the number of each text's)."""
    padded = [f" {t.lower()} " for t in texts]
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, padded), np.int64, len(padded))


def features(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hashed ids of the n-grams of one order."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h ^= points[i : i + n] * np.uint32(_PRIMES[i])
        h = (h << np.uint32(13)) | (h >> np.uint32(19))
        h *= np.uint32(5)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def batch_features(points: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of all texts, number of each text's): n-grams that reach into the next text are left out."""
    ends = np.cumsum(sizes)
    inside = np.ones(max(0, len(points) - order + 1), bool)
    for back in range(1, order):
        at = ends - back
        inside[at[at < len(inside)]] = False
    return features(points, order, bits)[inside], np.maximum(sizes - order + 1, 0)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of bounded size; a longer text is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > POINTS:
            yield start, i
            start, held = i, 0
        held += len(text) + 2
    if start < len(texts):
        yield start, len(texts)


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """One long text's points in pieces that overlap by the longest n-gram less one, with the n-grams that start in each its own."""
    for at in range(0, len(points), POINTS):
        yield points[at : at + POINTS + ORDERS[-1] - 1]


def scores(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Sums of log-probabilities, a row a text; texts of bounded size together, or a single one of any size."""
    bits = matrix.shape[0].bit_length() - 1
    points, sizes = points_of(texts)
    total = np.zeros((len(texts), matrix.shape[1]))
    if len(texts) == 1:
        for part in pieces(points):
            last = len(part) < POINTS + ORDERS[-1] - 1
            for order in ORDERS:
                own = features(part, order, bits)
                total[0] += np.add.reduce(matrix.take(own if last else own[:POINTS], axis=0), axis=0)
        return total
    for order in ORDERS:
        found, counts = batch_features(points, sizes, order, bits)
        some = np.flatnonzero(counts)
        if len(some):
            begin = (np.cumsum(counts) - counts)[some]
            total[some] += np.add.reduceat(matrix.take(found, axis=0), begin, axis=0)
    return total


def counted(texts: list[str], bits: int) -> np.ndarray:
    """How often each feature occurs in some texts."""
    sums = np.zeros(1 << bits, np.int64)
    for start, stop in chunks(texts):
        points, sizes = points_of(texts[start:stop])
        for order in ORDERS:
            sums += np.bincount(batch_features(points, sizes, order, bits)[0], minlength=1 << bits)
    return sums


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, smoothing: float = 0.5):
    """Model (languages sorted, log-probability matrix 2**bits x languages, log priors) from every labelled text.

    Rows whose text or label is null, or whose text has no letter, teach
    nothing. Without any labelled text the model knows no language. Many
    languages have fewer features each, so that the matrix keeps its bound.
    """
    known = docs.where(F.col(lang_col).isNotNull()).agg(F.count_distinct(F.col(lang_col).cast("string"))).first()[0]
    while known << bits > MATRIX and bits > 8:
        bits -= 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), {}
            for i, lang in enumerate(batch.column(1).to_pylist()):
                of.setdefault(lang, []).append(texts[i])
            for lang, own in of.items():
                sums = counted(own, bits)
                table[lang] = table[lang] + sums if lang in table else sums
                docs_of[lang] = docs_of.get(lang, 0) + len(own)
        for lang, sums in table.items():
            there = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(there) + 1)), pa.array(np.append(there, -1), pa.int32()), pa.array(np.append(sums[there], docs_of[lang]), pa.int64())], names=["lang", "feature", "n"])

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = labelled.mapInArrow(frugal(count), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # One row of packed counts a language and 4096 features: the matrix is what is collected, and its size is bounded.
    packed = sums.groupBy("lang", F.floor(F.col("feature") / 4096).alias("block")).agg(F.sort_array(F.collect_list(F.struct("feature", "n"))).alias("counts")).toLocalIterator()
    rows: dict[str, np.ndarray] = {}
    prior: dict[str, int] = {}
    for row in packed:
        sums_of = rows.setdefault(row["lang"], np.zeros(1 << bits))
        if len(rows) << bits > MATRIX:
            raise ValueError(f"more languages than a matrix of {MATRIX} entries holds")
        for feature, n in row["counts"]:
            if feature < 0:
                prior[row["lang"]] = n
            else:
                sums_of[feature] = n
    langs = sorted(rows)
    counts = np.array([rows[x] for x in langs]).reshape(len(langs), 1 << bits) + smoothing
    matrix = np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T)
    priors = np.log(np.array([prior[x] for x in langs], float) / sum(prior.values())) if langs else np.zeros(0)
    return langs, matrix, priors


def decide(texts: list[str | None], model) -> tuple[list[str], np.ndarray]:
    """(language, posterior probability) of each text; null means that it can't be told."""
    langs, matrix, priors = model
    labels, sure = ["und"] * len(texts), np.zeros(len(texts))
    told = [i for i, t in enumerate(texts) if t is not None] if langs else []
    for start, stop in chunks([texts[i] for i in told]):
        which = told[start:stop]
        total = scores([texts[i] for i in which], matrix) + priors
        best = total.argmax(axis=1)
        sure[which] = 1.0 / np.exp(total - total[np.arange(len(which)), best][:, None]).sum(axis=1)
        for i, k in zip(which, best, strict=True):
            labels[i] = langs[k]
    return labels, sure


def _with_letter(text_col: str):
    return F.when(F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False)), F.col(text_col))


def predict(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred and score, the posterior probability of the prediction.

    ``und`` with score 0 where the text is null or has no letter, or the model
    knows no language. Ties go to the language first in code point order. Every
    text is scored as a whole, by itself: neighbours in a batch don't matter. The
    columns kept may not be named like the two that are added. An empty table gives none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    chosen = docs.select(*keep, _with_letter(text_col).alias("_text"))
    schema = StructType([*chosen.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = decide(batch.column(len(keep)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return chosen.mapInArrow(frugal(run), schema)


def accepted(docs: DataFrame, model, least_score: float = 0.5, languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``least_score`` (and is one of ``languages``, if given).

    Only texts go to the Python workers, and only decisions come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        labels, sure = decide(texts.to_pylist(), shared.value)
        give_back()
        return pa.array([x != "und" and p >= least_score and (languages is None or x in languages) for x, p in zip(labels, sure, strict=True)], pa.bool_())

    return docs.where(fits(_with_letter(text_col)))
