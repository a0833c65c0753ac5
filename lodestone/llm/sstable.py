"""Sorted-string-table shards of token ids.

Documents are keyed by identifier, in ascending order over and within shards.
A shard is a run of blocks, each with prefix-compressed keys and the documents'
token ids, packed by Zstandard; then a sparse index with the first key, place
and running counts of every block; a Bloom filter over the keys; and a fixed
footer. A lookup asks the filter, searches the index and reads one block.
"""

from __future__ import annotations

import bisect
import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import pieces
from lodestone.llm.pieces import SPECIAL
from lodestone.llm.storage import PublishedFile, RangeReader, make_folder, materialise, new_folder
from lodestone.llm.wordbpe import byte_characters

FOOTER = struct.Struct("<QQQQQQBI4s")
MAGIC = b"LST2"
KEY_BYTES = 9
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 1 << 28
BLOCKS_A_TASK = 64
BITS_PER_KEY = 10
PROBES = 7


def key_of(doc_id: int | None) -> bytes:
    """9 bytes whose byte order is the order of signed 64-bit ids, no id coming first."""
    return bytes(KEY_BYTES) if doc_id is None else struct.pack(">BQ", 1, doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    there, shifted = struct.unpack(">BQ", key)
    return shifted - (1 << 63) if there else None


def _hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(key)
    return h & 0xFFFFFFFF, h >> 32 | 1


class Shard:
    """Writes one shard: add documents in ascending order, then finish."""

    def __init__(self, folder: str, width: int):
        import zstandard

        self.file = PublishedFile(folder, "shard", ".sst")
        self.width, self.packer = width, zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.docs = self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.head, self.body, self.held, self.before, self.first = [], [], 0, b"", None
        self.at = (self.docs, self.tokens)

    def add(self, doc_id: int | None, data: bytes) -> None:
        """``data`` holds the ids as little-endian unsigned integers of ``width`` bytes."""
        key = key_of(doc_id)
        same = 0
        if self.first is None:
            self.first = key
        else:
            while same < len(key) and key[same] == self.before[same]:
                same += 1
        self.head.append(struct.pack("<BBI", same, len(key) - same, len(data) // self.width) + key[same:])
        self.body.append(data)
        self.held += len(data)
        self.before = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.tokens += len(data) // self.width
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.head:
            raw = struct.pack("<I", len(self.head)) + b"".join(self.head) + b"".join(self.body)
            packed = self.packer.compress(raw)
            self.index.append((self.first, self.file.write(packed), len(packed), len(raw), *self.at))
            self._open()

    def finish(self) -> tuple[str, list[tuple]]:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 64) * 64)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            a, b = _hashes(key)
            for i in range(PROBES):
                spot = (a + i * b) % bits
                bloom[spot >> 3] |= 1 << (spot & 7)
        index = b"".join(k + struct.pack("<QIIQQ", *rest) for k, *rest in self.index)
        at_index = self.file.write(index)
        at_bloom = self.file.write(bytes(bloom))
        self.file.write(FOOTER.pack(at_index, len(self.index), at_bloom, bits, self.docs, self.tokens, self.width, zlib.crc32(index + bytes(bloom)), MAGIC))
        return self.file.publish(), self.index


class ShardReader:
    """Reads one shard: footer first, then index and filter, then blocks as asked for."""

    def __init__(self, path: str):
        self.reader = RangeReader(path)
        at_index, count, at_bloom, self.bits, self.docs, self.tokens, self.width, check, magic = FOOTER.unpack(self.reader.read(self.reader.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.bloom = self.reader.read(at_index, at_bloom - at_index), self.reader.read(at_bloom, self.bits // 8)
        if zlib.crc32(index + self.bloom) != check:
            raise ValueError("damaged index")
        size = KEY_BYTES + struct.calcsize("<QIIQQ")
        self.index = [(index[i * size : i * size + KEY_BYTES], *struct.unpack_from("<QIIQQ", index, i * size + KEY_BYTES)) for i in range(count)]

    def block(self, number: int) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens before it in this shard, ids as stored) of one block."""
        import zstandard

        _, offset, packed, raw, _, tokens = self.index[number]
        data = zstandard.ZstdDecompressor().decompress(self.reader.read(offset, packed), max_output_size=raw)
        (count,) = struct.unpack_from("<I", data)
        at, key, heads = 4, b"", []
        for _ in range(count):
            same, rest, n = struct.unpack_from("<BBI", data, at)
            key = key[:same] + data[at + 6 : at + 6 + rest]
            at += 6 + rest
            heads.append((id_of(key), n))
        for doc_id, n in heads:
            yield doc_id, tokens, data[at : at + n * self.width]
            at += n * self.width
            tokens += n

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of one document, or None: filter, binary search of the index, one block (the first row, if ids repeat)."""
        key = key_of(doc_id)
        a, b = _hashes(key)
        if not all(self.bloom[(s := (a + i * b) % self.bits) >> 3] >> (s & 7) & 1 for i in range(PROBES)):
            return None
        firsts = [x[0] for x in self.index]
        # Repeated ids may begin in the block before the one whose first key is the key.
        for number in range(max(0, bisect.bisect_left(firsts, key) - 1), len(firsts)):
            if firsts[number] > key:
                break
            for found, _, data in self.block(number):
                if found == doc_id:
                    return self.ids(data)
        return None


class LibraryEncoder:
    """Encodes by the tokenizers library; ids of split pieces are remembered within a bound.

    The merges reach across neither white space nor the splitter's pieces: a
    text's ids are those of its pieces, and the library's model is asked once
    for each piece that isn't remembered. Texts with special tokens' strings or
    unusual characters go to the library whole.
    """

    def __init__(self, path: str, remember: int = 1_000_000):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = re.compile("|".join(re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.unsettled = pieces.unsettled_pattern()
        self.characters = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.table = pieces.PieceTable(self.kind, remember)

    def whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def resolve(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library's model, and of the few whole texts marked as such by the library."""
        found = []
        for piece in new:
            if piece.startswith(SPECIAL):
                found.append(self.whole(piece[1:].decode()))
            else:
                # The model knows each byte by a character of its own.
                found.append([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.characters))])
        return np.array([i for ids in found for i in ids], self.kind), np.fromiter(map(len, found), np.int64, len(found))

    def units(self, text: str) -> list[str | list[bytes]]:
        if (not text.isascii() and self.unsettled.search(text)) or "<|" in text and self.special.search(text):
            return [[SPECIAL + text.encode()]]
        return [pieces.normalised(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); call with texts of bounded size together."""
        return pieces.encode([self.units(t) for t in texts], self.table, self.resolve)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as unsigned integers of ``width`` bytes."""
        out = []
        for start, stop in pieces.batches(texts):
            ids, offsets = self.encode(texts[start:stop])
            out += [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return out


@functools.lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of this worker process: what it remembers serves the tasks that follow."""
    return LibraryEncoder(path)


MANIFEST = "path string, block int, first_id long, docs_before long, tokens_before long, shard_docs long, shard_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards of token ids in ascending id order; returns their manifest, one row a block.

    Texts are dealt by ranges of the id before they are encoded, so one pass
    makes the files. A null text is an empty one: it has ``end_id`` alone. A
    null id has a key of its own, before all others. Rows that share an id, or
    have none, are all kept, in the order of their texts. An empty table gives
    no shard.
    """
    folder = new_folder(docs.sparkSession, "sst")
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, end = None, None, b""

        def finish():
            path, index = shard.finish()
            columns = list(zip(*[(path, i, id_of(k), docs, tokens, shard.docs, shard.tokens) for i, (k, _, _, _, docs, tokens) in enumerate(index)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["path", "block", "first_id", "docs_before", "tokens_before", "shard_docs", "shard_tokens"])

        try:
            for batch in batches:
                if encoder is None:
                    encoder = library_encoder(tokenizer)
                    end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for start, stop in pieces.batches(texts):
                    ids, offsets = encoder.encode(texts[start:stop])
                    for doc_id, a, b in zip(keys[start:stop], offsets[:-1], offsets[1:], strict=True):
                        if shard is None:
                            shard = Shard(folder, encoder.width)
                        shard.add(doc_id, ids[a:b].tobytes() + end)
                        if shard.file.position >= SHARD_BYTES:
                            ready, shard = finish(), None
                            yield ready
            if shard is not None:
                ready, shard = finish(), None
                yield ready
        finally:
            if shard is not None:
                shard.file.discard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(run, MANIFEST), "sst-index")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files; start counts the ids of all documents before.

    The running sum goes over shards, in key order: one small row a shard.
    """
    shards = manifest.where("block = 0").select("path", "first_id", "shard_tokens")
    offsets = shards.withColumn("offset", F.sum("shard_tokens").over(Window.orderBy("first_id", "path")) - F.col("shard_tokens")).select("path", "offset")
    # A stated number of partitions: Spark would else take these few small rows for little work.
    tasks = -(-manifest.count() // BLOCKS_A_TASK)
    blocks = manifest.select("path", "block").join(offsets, "path").repartition(max(1, tasks), "path", "block")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work: dict[tuple[str, int], list[int]] = {}
            for path, block, offset in zip(*(batch.column(x).to_pylist() for x in ("path", "block", "offset")), strict=True):
                work.setdefault((path, offset), []).append(block)
            for (path, offset), numbers in work.items():
                shard = ShardReader(path)
                for number in sorted(numbers):
                    rows = []
                    for doc_id, before, data in shard.block(number):
                        ids = shard.ids(data)
                        rows.append((doc_id, offset + before, len(ids), zlib.crc32(ids.tobytes()), ids))
                    columns = list(zip(*rows, strict=True))
                    made = [pa.array(c, pa.int64()) for c in columns[:4]]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        made.append(pa.array([x.astype(np.int64) for x in columns[4]], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(made, names=names)
                shard.reader.close()

    return blocks.mapInArrow(run, schema)


def lookup(manifest: DataFrame, doc_id: int | None) -> np.ndarray | None:
    """Ids of one document (None: of one without id): the shard by its first key, then filter, index and one block."""
    reaches = F.col("first_id").isNull() | F.coalesce(F.col("first_id") <= F.lit(doc_id).cast("long"), F.lit(False))
    nearby = manifest.where((F.col("block") == 0) & reaches).orderBy(F.desc_nulls_last("first_id"), "path").limit(1).collect()
    return ShardReader(nearby[0]["path"]).get(doc_id) if nearby else None
