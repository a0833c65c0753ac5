"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes are signs after rotations learned (iterative quantisation: principal
axes, then alternating signs and an orthogonal Procrustes step) on a bounded
sample; several rotations give a code more bits than a vector has components,
so that a Hamming radius tells neighbours from others. A code is split into
substrings and each is an index of its own: of two codes that differ in at most
``r = a * substrings + b`` bits, one of the first b + 1 substrings differs in at
most a bits, or one of the others in at most a - 1. Probing all values that near
retrieves every code within the radius. These are checked by whole code and
reranked by the floats. Rows are dealt into tiles of bounded numbers of vectors
and queries; the index covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.storage import materialise

#: The most rows that teach the rotation and the radius.
SAMPLE = 20_000
VECTORS_A_TILE = 16_384
QUERIES_A_TILE = 4_096
SUBSTRING_BITS = 16
ROTATIONS = 4


def _matrix(column: pa.Array) -> np.ndarray:
    """Double matrix of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: id and vector not null, not empty, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class Codes:
    """Learned rotations; a code has ``ROTATIONS`` times as many bits as axes, at most ``axes`` or the dimension, filled up to whole substrings."""

    def __init__(self, sample: np.ndarray, axes: int = 64, rounds: int = 30, seed: int = 7):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, vectors = np.linalg.eigh(centred.T @ centred)
        main = vectors[:, ::-1][:, : min(axes, sample.shape[1])]
        flat = centred @ main
        turned = []
        for i in range(ROTATIONS):
            turn = np.linalg.qr(np.random.default_rng(seed + i).normal(size=(flat.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (u @ w).T
            turned.append(main @ turn)
        self.project = np.hstack(turned)
        self.bits = -(-self.project.shape[1] // SUBSTRING_BITS) * SUBSTRING_BITS

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes, a column of 16 bits a substring."""
        signs = np.zeros((len(x), self.bits), np.uint8)
        signs[:, : self.project.shape[1]] = (x - self.mean) @ self.project > 0
        return np.packbits(signs, axis=1).view(np.uint16)


def hamming(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 4 == 0 and codes.flags.c_contiguous:
        code, codes = np.ascontiguousarray(code).view(np.uint64), codes.view(np.uint64)
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learn(sample: np.ndarray, k: int, share: float = 0.97, axes: int = 64) -> tuple[Codes, int]:
    """(codes, radius): within it lie ``share`` of the k nearest of the sample's first 200 rows.

    Neighbours in a sample are farther away than those among all rows, so the
    radius errs on the wide side.
    """
    codes = Codes(sample, axes)
    packed = codes.encode(sample)
    far = []
    for i in range(min(200, len(sample))):
        score = sample @ sample[i]
        score[i] = -np.inf
        top = np.argpartition(-score, min(k, len(score) - 1))[: min(k, len(score) - 1)]
        far.append(hamming(packed[i], packed[top]))
    spread = np.concatenate(far) if far else np.zeros(0)
    return codes, int(np.ceil(np.quantile(spread, share))) if len(spread) else codes.bits


class MultiIndex:
    """Substring tables over the codes of one tile."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.shape[1]
        self.order, self.values, self.begin = [], [], []
        for j in range(self.parts):
            order = np.argsort(codes[:, j], kind="stable").astype(np.int32)
            values, begin = np.unique(codes[order, j], return_index=True)
            self.order.append(order)
            self.values.append(values)
            self.begin.append(np.append(begin, len(codes)))

    def _probe(self, j: int, value: np.uint16, reach: int, hit: np.ndarray) -> None:
        """Marks the rows whose j-th substring differs from ``value`` in at most ``reach`` bits."""
        values, begin = self.values[j], self.begin[j]
        if reach < len(MASKS) and len(MASKS[reach]) < len(values):
            asked = np.sort(MASKS[reach] ^ value)
            at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
            at = at[values[at] == asked]
        else:
            # There are fewer values in the table than values that near.
            at = np.flatnonzero(np.bitwise_count(values ^ value) <= reach)
        first, count = begin[at], begin[at + 1] - begin[at]
        total = int(count.sum())
        if total:
            hit[self.order[j][np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)]] = True

    def radius(self, code: np.ndarray, r: int) -> np.ndarray:
        """Rows within Hamming distance r, found by probing the substrings."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        reach, more = divmod(r, self.parts)
        hit = np.zeros(len(self.codes), bool)
        for j in range(self.parts):
            own = reach if j <= more else reach - 1
            if own >= 0:
                self._probe(j, code[j], own, hit)
        rows = np.flatnonzero(hit)
        return rows[hamming(code, self.codes[rows]) <= r]


def _masks(most: int) -> list[np.ndarray]:
    every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
    weight = np.bitwise_count(every)
    return [every[weight <= r] for r in range(most + 1)]


#: The differences of at most 0, 1, 2 and 3 bits.
MASKS = _masks(3)


def best_of(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids with the highest scores, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], score[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", axes: int = 64, share: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest found, by inner product.

    Score is the inner product in double precision on the original vectors;
    ties go to the smaller id, and a query's own id is no candidate. Where a
    tile has fewer than k rows within the radius, the radius is widened until
    it has: every query gets k rows, or all candidates if there are fewer. Rows
    whose vector is null, empty, zero, of another length than most, or has a
    null or non-finite component take no part, and give no rows as queries.
    Of an id that several rows share all vectors ask and answer, and the best
    pair counts. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("v") == sizes["d"]), asked.where(F.size("v") == sizes["d"])
    n, q = sizes["count"], asked.count()
    fraction = min(1 << 31, max(1, -(-SAMPLE * (1 << 31) // n)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 31)) < fraction).orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(SAMPLE).select("v").toArrow()
    model = spark.sparkContext.broadcast(learn(_matrix(sample.column(0)), k, share, axes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _ = model.value
        for batch in batches:
            packed = codes.encode(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in packed], pa.binary())], names=["vec_id", "v", "code"])

    index = materialise(rows.mapInArrow(encode, "vec_id long, v array<double>, code binary"), "ann-index")
    tiles, blocks = -(-n // VECTORS_A_TILE), max(1, -(-q // QUERIES_A_TILE))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    both = index.select(place(tiles).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "vec_id", "v", "code").unionByName(
        asked.mapInArrow(encode, "vec_id long, v array<double>, code binary").select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), place(blocks).alias("block"), F.lit(True).alias("asks"), "vec_id", "v", "code")
    )

    def search(group: pa.Table) -> pa.Table:
        _, radius = model.value
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = group.column("vec_id").to_numpy(), _matrix(group.column("v"))
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint16).reshape(len(ids), -1)
        data, own, tables = x[~asks], ids[~asks], MultiIndex(codes[~asks])
        single = len(np.unique(own)) == len(own)
        out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for query, vector, code in zip(ids[asks].tolist(), x[asks], codes[asks], strict=True):
            r = radius
            while True:
                found = tables.radius(code, r)
                found = found[own[found] != query]
                if (len(found) if single else len(np.unique(own[found]))) >= k or r >= codes.shape[1] * SUBSTRING_BITS:
                    break
                r = min(r + 4, codes.shape[1] * SUBSTRING_BITS)
            if len(found):
                score = (data[found] * vector).sum(axis=1)
                if single and len(found) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[score >= least], score[score >= least]
                out.setdefault(query, []).append(best_of(own[found], score, k))
        best = [(q, *(parts[0] if len(parts) == 1 else best_of(*(np.concatenate(c) for c in zip(*parts, strict=True)), k))) for q, parts in out.items()]
        join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        return pa.table({"query_id": pa.array(join([np.full(len(v), q) for q, v, _ in best], np.int64), pa.int64()), "vec_id": pa.array(join([v for _, v, _ in best], np.int64), pa.int64()), "score": pa.array(join([s for _, _, s in best], np.float64), pa.float64())})

    found = both.groupBy("tile", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
