"""N-gram Jaccard join by PartEnum signatures, and near-duplicate components.

A document's set holds the hashes of its distinct word shingles. Sets are cut
into size bands; for the pairs that one band (or two neighbours) can form, a
Jaccard threshold bounds the symmetric difference by ``k``. The feature domain
is partitioned into ``n1`` ranges and each range into ``n2`` parts; a set's
projections on all subsets of ``m`` parts of one range are its signatures. A
pair within the bound agrees on some: k differences damage so few parts that at
least ``agree`` subsets stay whole, so similar sets share one. Where k is small,
sets are small too, and subsets of two parts keep projections from being nearly
empty; where it is large, single parts (``n2 = m = 1``) give the fewest
signatures. Of its projections, ordered by size and then by place, a set
withholds the ``agree - 1`` smallest: the last projection on which two similar
sets agree has as many that agree below it, so neither withholds it. ``k`` may be
the set's own bound, from its size and the largest partner that it can have in
the instance, since a pair keeps to the bounds of both. No similar pair is lost.

Sets that share a signature form a bucket. Each bucket compares its members
with one pivot only; what that leaves open after the components are known is
compared pair by pair in small buckets and block by block in large ones, so
the result is exact without emitting all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.idfilter import bloom_bitmap, may_contain
from lodestone.llm.storage import materialise
from lodestone.llm.workers import frugal

U = np.uint64
SMALL_BUCKET = 24
BLOCK_SHINGLES = 2_000_000
SKETCH_BITS = 2048
#: Up to this bound, projections are on two parts each: their number grows by half, their sizes too.
PAIRS_UP_TO = 8


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class WordHashes(dict):
    """64-bit hash of a word, remembered; the memory is bounded by ``most`` entries."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, words: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words cut at ASCII white space."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, U)
    h = np.fromiter(map(memo.__getitem__, found), U, len(found))
    n, width = max(1, len(h) - words + 1), min(words, len(h))
    rolled = np.full(n, width, U)
    factor = 0x9E3779B97F4A7C15
    for i in range(width):
        rolled += h[i : i + n] * U(factor)
        factor = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
    return np.unique(mix(rolled))


@dataclass(frozen=True)
class Family:
    """Projections on the subsets of ``m`` of the ``n2`` parts of each of ``n1`` ranges."""

    n1: int
    n2: int
    m: int

    @property
    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.m))

    def agree(self, k: int) -> int:
        """Projections that k differences leave whole at least: what they damage is least useful to them spread evenly, as binomials are convex."""
        each, more = divmod(k, self.n1)
        return more * comb(max(0, self.n2 - each - 1), self.m) + (self.n1 - more) * comb(max(0, self.n2 - each), self.m)


def family(k: int) -> Family:
    """Subsets of two of three parts while k is at most PAIRS_UP_TO, else single ranges with some to spare."""
    if 0 < k <= PAIRS_UP_TO:
        return Family(k // 2 + 1, 3, 2)
    return Family(k + 1 + (k + 7) // 7 if k else 1, 1, 1)


@dataclass(frozen=True)
class PartEnum:
    """Bands and partitions for Jaccard >= num/den (0 < num <= den)."""

    num: int
    den: int

    def bands(self, longest: int = 1 << 16) -> tuple[np.ndarray, list[int], list[Family]]:
        """Least size of each band up to that of ``longest`` and the next, with the bound k and the family of projections of its instance."""
        least, bound, families = [], [], []
        low = 1
        while len(least) < 2 or least[-2] <= longest:
            high = low * self.den // self.num
            k = (self.den - self.num) * 2 * high // (self.den + self.num)
            least.append(low)
            bound.append(k)
            families.append(family(k))
            low = high + 1
        return np.array(least), bound, families

    def own_bound(self, n: int, least: int, high: int) -> int:
        """Largest symmetric difference of a set of size n and a similar one of a size up to ``high``; -1 if none reaches ``least``."""
        partner = min(high, n * self.den // self.num)
        return -1 if partner < least else (self.den - self.num) * (n + partner) // (self.den + self.num)

    def fits(self, a: int, b: int) -> bool:
        return min(a, b) * self.den >= max(a, b) * self.num

    def similar(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)


def signatures(h: np.ndarray, sums: np.ndarray, j: int, k: int, kind: Family) -> np.ndarray:
    """The signatures of a sorted set in instance j for the bound k; ``sums`` are running sums of its element weights, from 0."""
    parts = kind.n1 * kind.n2
    withheld = kind.agree(k) - 1
    place = (h >> U(32)) * U(parts) >> U(32)
    if kind.n2 > 1:
        begin = np.searchsorted(place, np.arange(parts + 1, dtype=U))
        count, value = np.diff(begin).reshape(kind.n1, kind.n2), np.diff(sums[begin]).reshape(kind.n1, kind.n2)
        chosen = np.array(kind.subsets)
        count, value = count[:, chosen].sum(axis=2).ravel(), np.add.reduce(value[:, chosen], axis=2).ravel()
        place = np.arange(len(count), dtype=U)
        if withheld:
            rank = count * len(count) + np.arange(len(count))
            keep = rank >= np.partition(rank, withheld)[withheld]
            place, value = place[keep], value[keep]
    else:
        start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        end = np.append(start[1:], len(h))
        count = end - start
        empty = parts - len(start)
        place, value = place[start], sums[end] - sums[start]
        if withheld >= empty:
            rank = count * parts + place.astype(np.int64)
            keep = rank >= np.partition(rank, withheld - empty)[withheld - empty]
            place, value = place[keep], value[keep]
        else:
            missing = np.setdiff1d(np.arange(parts, dtype=U), place)[withheld:]
            place, value = np.concatenate((place, missing)), np.concatenate((value, np.zeros(len(missing), U)))
    return mix(value + mix(place * U(0x9E3779B97F4A7C15) + U(j * 0xC2B2AE3D27D4EB4F % (1 << 64))))


SKETCH = "key long, n int, c long, doc_id long, th long, d2 long"
FOUND = "kind int, key long, c long, n int, doc_id long, th long, d2 long, pivot long, pivot_n int"


def _sketch(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, rule, reach = WordHashes(), PartEnum(num, den), 1 << 16
        least, bound, ranges = rule.bands(reach)
        seen: set[tuple[int, int]] = set()
        given = 0
        schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("c", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("d2", pa.int64())])

        def out(key, n, c, doc_id=None, th=None, d2=None):
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(c, pa.int64()), none if doc_id is None else doc_id, none if th is None else th, none if d2 is None else pa.array(d2, pa.int64())], schema=schema)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            docs_n, docs_c, docs_d = np.zeros(len(texts), np.int32), np.zeros(len(texts), U), np.zeros(len(texts), U)
            keys, sizes, classes, waiting = [], [], [], 0
            for i, text in enumerate(texts):
                h = shingle_set(text.as_py(), words, memo)
                n = len(h)
                if not n:
                    continue
                g = mix(h + U(0x5851F42D4C957F2D))
                sums = np.zeros(n + 1, U)
                np.cumsum(g, out=sums[1:])
                c, d = mix(sums[-1:] + U(n))[0], mix(np.add.reduce(mix(h ^ U(0xA0761D6478BD642F)), keepdims=True) + U(n))[0]
                docs_n[i], docs_c[i], docs_d[i] = n, c, d
                if (c, d) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add((c, d))
                if n > reach:
                    reach = 2 * n
                    least, bound, ranges = rule.bands(reach)
                band = int(np.searchsorted(least, n, "right")) - 1
                for j, size in ((band, n), (band + 1, -n)):
                    k = rule.own_bound(n, int(least[j]) if size < 0 else 1, int(least[j]) * den // num)
                    if k < 0:
                        continue
                    sig = signatures(h, sums, j, min(k, bound[j]), ranges[j])
                    keys.append(sig)
                    sizes.append(np.full(len(sig), size, np.int32))
                    classes.append(np.full(len(sig), c, U))
                    waiting += len(sig)
                if waiting >= 200_000:
                    yield out(np.concatenate(keys).view(np.int64), np.concatenate(sizes), np.concatenate(classes).view(np.int64))
                    keys, sizes, classes, waiting = [], [], [], 0
            if waiting:
                yield out(np.concatenate(keys).view(np.int64), np.concatenate(sizes), np.concatenate(classes).view(np.int64))
            # Rows of documents go anywhere: by their number here, so that neither null nor repeated ids meet.
            spread = mix(np.arange(given, given + len(texts), dtype=np.int64).view(U) + U(1))
            given += len(texts)
            yield out(spread.view(np.int64), docs_n, docs_c.view(np.int64), batch.column(0), batch.column(2), docs_d.view(np.int64))

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (key, n descending, c); keeps documents, and bucket members other than their pivot.

    Members of the band below carry -n. A bucket without a member of its own
    band is dropped: those pairs meet in the instance of the band below.
    """
    names = ["kind", "key", "c", "n", "doc_id", "th", "d2", "pivot", "pivot_n"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    carried = None  # key, pivot, pivot's n, last c
    for batch in batches:
        is_doc = batch.column("d2").is_valid()
        docs = batch.filter(is_doc)
        if len(docs):
            m = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), docs.column("key"), docs.column("c"), docs.column("n"), docs.column("doc_id"), docs.column("th"), docs.column("d2"), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], schema=schema)
        sigs = batch.filter(pa.compute.invert(is_doc))
        m = len(sigs)
        if not m:
            continue
        key, c, n = (sigs.column(x).to_numpy() for x in ("key", "c", "n"))
        start = np.ones(m, bool)
        start[1:] = key[1:] != key[:-1]
        start[0] = carried is None or key[0] != carried[0]
        same = np.zeros(m, bool)
        same[1:] = (c[1:] == c[:-1]) & ~start[1:]
        same[0] = not start[0] and c[0] == carried[3]
        first = np.maximum.accumulate(np.where(start, np.arange(m), -1))
        pivot, pivot_n = c[first].copy(), n[first].copy()
        if not start[0]:
            pivot[first < 0], pivot_n[first < 0] = carried[1], carried[2]
        carried = key[-1], pivot[-1], pivot_n[-1], c[-1]
        keep = ~start & ~same & (pivot_n > 0) & (c != pivot)
        if keep.any():
            none = pa.nulls(int(keep.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(none), np.int32)), pa.array(key[keep]), pa.array(c[keep]), pa.array(n[keep]), none, none, none, pa.array(pivot[keep]), pa.array(pivot_n[keep])], schema=schema)


def _with_parity(words: int):
    """Adds a set's size and the parities of its elements in SKETCH_BITS places, as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sizes, bits = [], []
            for text in batch.column("text").cast(pa.binary()):
                h = shingle_set(text.as_py(), words, memo)
                sizes.append(len(h))
                places = np.bincount((h & U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                bits.append(np.packbits(places.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["node", "text", "size", "parity"])

    return run


def _verify(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, memo = PartEnum(num, den), WordHashes()
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def of(node, text):
            nonlocal held
            if (h := sets.get(node)) is None:
                if held > 4_000_000:
                    sets.clear()
                    held = 0
                h = sets[node] = shingle_set(text.as_py(), words, memo)
                held += len(h)
            return h

        for batch in batches:
            a, b, ta, tb = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary())
            found = []
            for i in range(len(a)):
                x, y = of(a[i], ta[i]), of(b[i], tb[i])
                if rule.fits(len(x), len(y)) and rule.similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(found, pa.int64())), batch.column("b").take(pa.array(found, pa.int64()))], names=["a", "b"])

    return run


def _verify_blocks(words: int, num: int, den: int):
    """Links between the members of two blocks of one bucket: a spanning forest over their components."""

    def run(group: pa.Table) -> pa.Table:
        rule, memo = PartEnum(num, den), WordHashes()
        block = group.column("block").to_numpy()
        low, high = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        nodes, roots = group.column("node").to_pylist(), group.column("root").to_pylist()
        sets = [shingle_set(t.as_py(), words, memo) for t in group.column("text").cast(pa.binary())]
        size = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(ids, kind="stable")
        posting, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(ids))))
        at = np.concatenate(([0], np.cumsum(size)))
        parent = {r: r for r in roots}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for x in np.flatnonzero(block == low):
            mine = ids[at[x] : at[x + 1]]
            count = begin[mine + 1] - begin[mine]
            where = np.repeat(begin[mine] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            inter = np.bincount(posting[where], minlength=len(sets))
            near = (rule.den * inter >= rule.num * (size[x] + size - inter)) & (block == high)
            if low == high:
                near[: x + 1] = False
            for y in np.flatnonzero(near):
                p, q = find(roots[x]), find(roots[y])
                if p != q:
                    parent[p] = q
                    a.append(nodes[x])
                    b.append(nodes[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def near_duplicate_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, stays): exact components of the Jaccard >= num/den join.

    ``component_id`` is the smallest id in the component. A text that is null or
    has no word has an empty set, links with nothing and is its own component.
    A text of fewer words than ``words`` has one shingle. Each input row gives
    one row: repeated rows and rows that share an id but not a text are kept
    apart; a row without id takes part and has the smallest id of its
    component, or null. ``text_hash`` is the text's xxhash64, and ``stays`` says
    whether id and text are those of the component's first row: that with the
    smallest id, then the smallest hash, rows without id coming last. Rows with
    an empty set stay. Other columns are ignored. An empty table gives none.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    found = base.mapInArrow(frugal(_sketch(words, num, den)), SKETCH).repartition("key").sortWithinPartitions("key", F.desc("n"), "c").mapInArrow(frugal(_scan), FOUND)
    found = materialise(found, "partenum")
    rows = found.where("kind = 0").select("doc_id", "n", "c", "d2", "th", F.concat(F.to_binary(F.hex("c"), F.lit("hex")), F.to_binary(F.lpad(F.hex("d2"), 16, "0"), F.lit("hex"))).alias("node"))
    classes = rows.where("n > 0").groupBy("c", "node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"), F.max("n").alias("n")).select("c", "node", "n", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), "first")
    members = found.where("kind = 1").select("key", "c", "n", "pivot", "pivot_n")

    in_buckets = members.select("c").unionByName(members.select(F.col("pivot").alias("c"))).distinct()
    wanted = materialise(classes.join(in_buckets, "c"), "candidates")
    # One text of each class; both the join and the choice among repeated rows keep to the dealing by "own".
    wanted_texts = wanted.select("node", "rep", F.col("th").alias("th2"), F.xxhash64("rep", "th").alias("h"))
    own = base.withColumn("own", F.xxhash64("doc_id", "th")).where(may_contain(bloom_bitmap(wanted_texts, "h"), F.col("own")))
    texts = own.join(wanted_texts, (F.col("own") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("th2")))
    texts = texts.select("own", "node", "text").dropDuplicates(["own", "node"]).select("node", "text").mapInArrow(frugal(_with_parity(words)), "node binary, text string, size long, parity array<long>")
    texts = materialise(texts, "texts")

    def texts_of(some: DataFrame, column: str) -> DataFrame:
        """Texts of the nodes in a written table's column, and few others."""
        return texts.where(may_contain(bloom_bitmap(some.select(F.xxhash64(column).alias("h")), "h"), F.xxhash64("node"))).select("node", "text")

    def links_of(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("parity").alias(f"parity_{side}")), side)
        differ = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        pairs = materialise(pairs.where(differ * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num)).select("a", "b"), "near-pairs")
        with_a = pairs.join(texts_of(pairs, "a").toDF("a", "ta"), "a")
        both = with_a.join(texts_of(pairs, "b").toDF("b", "tb"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(frugal(_verify(words, num, den)), "a binary, b binary")

    fits = F.least(F.abs("n"), "pivot_n").cast("long") * den >= F.greatest(F.abs("n"), "pivot_n").cast("long") * num
    star = members.where(fits).select("c", "pivot").distinct()
    by_class = wanted.select("c", "node", F.col("n").alias("size"))
    star = star.join(by_class.select("c", F.col("node").alias("b")), "c").join(by_class.select(F.col("c").alias("pivot"), F.col("node").alias("a")), "pivot").select("a", "b")
    links = materialise(links_of(star), "links", small_rows=True)
    roots = materialise(connected_components(links), "roots")

    # Members other than the pivot, in buckets that still hold several components.
    open_members = (
        members.join(by_class, "c").join(roots, "node", "left").select("key", "node", "size", (F.col("n") > 0).alias("own"), F.coalesce("root", "node").alias("root"))
    )
    open_keys = open_members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("size").alias("largest"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.max("own").alias("some_own")).where("m > 1 and r1 <> r2 and some_own")
    open_members = materialise(open_members.join(open_keys.select("key", "m", "largest"), "key"), "open")

    few = open_members.where(F.col("m") <= SMALL_BUCKET)
    x, y = (few.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "own", "root"))) for s in "xy")
    rest = (
        x.join(y, "key")
        .where((F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & (F.col("x_own") | F.col("y_own")))
        .where(F.least("x_size", "y_size").cast("long") * den >= F.greatest("x_size", "y_size").cast("long") * num)
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
        .distinct()
    )
    large = open_members.where(F.col("m") > SMALL_BUCKET)
    many = large.withColumn("blocks", F.ceil(F.col("m") * F.col("largest") / F.lit(BLOCK_SHINGLES)).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(texts_of(large, "node"), "node")
    blocked = many.groupBy("key", "i", "j").applyInArrow(_verify_blocks(words, num, den), "a binary, b binary")
    late = materialise(links_of(rest).unionByName(blocked), "late-links", small_rows=True)
    if not late.isEmpty():
        edges = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late)
        roots = materialise(connected_components(edges), "roots")

    linked = classes.join(roots, "node").select("node", "root", "first")
    lifted = linked.join(linked.groupBy("root").agg(F.min("first").alias("lead")), "root").select("node", "lead")
    out = rows.where("n > 0").select("doc_id", "n", "c", "node", "th").join(classes.select("c", "node", "first"), ["c", "node"]).join(lifted, "node", "left").withColumn("lead", F.coalesce("lead", "first"))
    stays = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"), F.col("th").alias("text_hash"), stays.alias("stays"))
    return out.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("th").alias("text_hash"), F.lit(True).alias("stays")))


def without_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each component.

    The row with the smallest id stays (of rows without id, only where no
    other is in the component); ties, as among repeated rows, leave one row.
    Rows without words are in no component and stay. Texts are shuffled of the
    rows that go, and of repeated ones: a Bloom filter lets the others pass.
    """
    found = near_duplicate_components(docs, words, num, den, id_col, text_col).select("doc_id", "text_hash", (F.col("n_shingles") > 0).alias("counts"), "stays")
    found = materialise(found, "components")
    marked = found.where("not stays").select("doc_id", "text_hash", F.lit(False).alias("once")).distinct()
    repeated = found.where("stays and counts").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id", "text_hash", F.lit(True).alias("once"))
    marked = materialise(marked.unionByName(repeated).select(F.xxhash64("doc_id", "text_hash").alias("h"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text"), "once"), "marked")

    # The row travels as one struct, so that its columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th")).withColumn("own", F.xxhash64("doc_id", "th"))
    rows = rows.withColumn("maybe", may_contain(bloom_bitmap(marked, "h"), F.col("own")))
    same = (F.col("own") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("text"))
    out = rows.where("not maybe").select("row").unionByName(rows.where("maybe").join(marked, same, "left_anti").select("row"))
    again = marked.where("once")
    if not again.isEmpty():
        place = F.row_number().over(Window.partitionBy("h", "id", "text").orderBy(F.to_json("row")))
        out = out.unionByName(rows.where("maybe").join(again, same).withColumn("place", place).where("place = 1").select("row"))
    return out.select("row.*")
