"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent frames, each holding a group of whole
WARC records, followed by a seek table in a skippable frame (the published
seekable format): any record is read from its frame alone. The index maps
record ids to bundle, frame and offset within the frame. Records with equal
payloads are written once; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.storage import PublishedFile, RangeReader, make_folder, materialise, new_folder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
FRAMES_A_TASK = 64
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, digest: str, copy: int = 1) -> str:
    """Id of a record: of its page, its payload and, from the second row that shares both on, a number."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{'' if copy == 1 else f':{copy}'}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, copy: int) -> bytes:
    """One WARC/1.1 record; a revisit keeps the full payload's digest and length in its headers and an empty block."""
    block = payload if refers_to is None else b""
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id, digest, copy)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of one frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("record length is wrong")
        yield at, head, data[start:stop]
        at = stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, raw) sizes of all frames and the footer that a reader looks for first."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(reader: RangeReader) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of every frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", reader.read(reader.size - 9, 9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    body = reader.read(reader.size - 9 - width * count, width * count)
    at, out = 0, []
    for i in range(count):
        packed, raw = struct.unpack_from("<II", body, i * width)
        out.append((at, packed, raw))
        at += packed
    return out


def plan_records(pages: DataFrame, least_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, refers_to, copy): refers_to is null for responses, payload for revisits.

    Of equal payloads of ``least_payload`` bytes or more the smallest page_id
    responds. A null html is an empty payload. A row without page_id always
    responds; of rows that share the smallest page_id each is a response.
    ``copy`` numbers rows that share page and payload. Other columns are ignored.

    Payloads travel only with rows that respond, dealt by payload and page, so
    that many copies of one page meet nowhere but as narrow rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"))
    shared = F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_payload)
    first = base.where(shared).groupBy("sha1").agg(F.min("page_id").alias("first")).withColumnRenamed("sha1", "own")
    place = F.row_number().over(Window.partitionBy("sha1", "page_id").orderBy("url"))
    columns = ["page_id", "url", "payload", "payload_bytes", "sha1", "refers_to", "copy"]
    none = F.lit(None).cast("long").alias("refers_to")
    lead = base.where(shared).join(first, (F.col("sha1") == F.col("own")) & (F.col("page_id") == F.col("first"))).select("page_id", "url", "payload", "payload_bytes", "sha1", none).withColumn("copy", place)
    later = base.where(shared).select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "sha1").join(first, F.col("sha1") == F.col("own")).where(F.col("page_id") != F.col("first")).withColumn("refers_to", F.col("first")).withColumn("copy", place)
    alone = base.where(~shared).select("page_id", "url", "payload", "payload_bytes", "sha1", none).withColumn("copy", F.monotonically_increasing_id() + 2)
    return lead.select(*columns).unionByName(later.select(*columns)).unionByName(alone.select(*columns))


MANIFEST = "path string, frame int, page_id long, at int"


def write_archives(records: DataFrame, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write bundles to the shared folder; returns the index (path, frame, page_id, offset in the frame)."""
    folder = new_folder(records.sparkSession, "warc")
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        out, frames, entries, waiting, held = None, [], [], [], 0

        def flush():
            nonlocal out, waiting, held
            if waiting:
                if out is None:
                    out = PublishedFile(folder, "bundle", ".warc.zst")
                packed = packer.compress(b"".join(waiting))
                out.write(packed)
                frames.append((len(packed), held))
                waiting, held = [], 0

        def close():
            nonlocal out, frames, entries
            flush()
            if out is None:
                return None
            out.write(seek_table(frames))
            path = out.publish()
            columns = list(zip(*entries, strict=True))
            ready = pa.RecordBatch.from_arrays([pa.array([path] * len(entries)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["path", "frame", "page_id", "at"])
            out, frames, entries = None, [], []
            return ready

        try:
            for batch in batches:
                ids, urls, sizes, shas, refers, copies = (batch.column(x).to_pylist() for x in ("page_id", "url", "payload_bytes", "sha1", "refers_to", "copy"))
                for i, payload in enumerate(batch.column("payload")):
                    digest = base64.b32encode(bytes.fromhex(shas[i])).decode()
                    record = warc_record(ids[i], urls[i], payload.as_py(), sizes[i], digest, refers[i], copies[i])
                    if held and held + len(record) > frame_bytes:
                        flush()
                    entries.append((len(frames), ids[i], held))
                    waiting.append(record)
                    held += len(record)
                if out is not None and out.position >= bundle_bytes and (ready := close()) is not None:
                    yield ready
            if (ready := close()) is not None:
                yield ready
        finally:
            if out is not None:
                out.discard()

    return materialise(records.mapInArrow(run, MANIFEST), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, frame int, at int"


def read_archives(spark: SparkSession, index: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame through the seek tables.

    A response's payload must have the digest that its header states.
    """
    frames = index.select("path", "frame").distinct()
    # A stated number of partitions: Spark would else take these few small rows for little work.
    frames = frames.repartition(max(1, -(-frames.count() // FRAMES_A_TASK)), "path", "frame")
    schema = RECORDS + (", payload binary" if payload else "")

    def number(uri: str | None) -> int | None:
        page = uri[len("<urn:page:") : -1].split(":")[0] if uri else ""
        return int(page) if page else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            table: dict[str, list[int]] = {}
            for path, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table.setdefault(path, []).append(frame)
            for path, wanted in table.items():
                reader = RangeReader(path)
                places = read_seek_table(reader)
                for frame in sorted(wanted):
                    offset, packed, raw = places[frame]
                    rows = []
                    for at, head, block in parse_records(unpacker.decompress(reader.read(offset, packed), max_output_size=raw)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (payload_digest(block) != digest or len(block) != int(head["X-Payload-Length"])):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']} in {path}")
                        rows.append((number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), head["WARC-Target-URI"], path, frame, at, block)[: 10 if payload else 9])
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "frame", "at", "payload"]
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: 10 if payload else 9])
                reader.close()

    return frames.mapInArrow(run, schema)


def read_record(path: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and a single frame."""
    import zstandard

    reader = RangeReader(path)
    offset, packed, raw = read_seek_table(reader)[frame]
    data = zstandard.ZstdDecompressor().decompress(reader.read(offset, packed), max_output_size=raw)
    reader.close()
    _, head, block = next(parse_records(data[at:]))
    return head, block
