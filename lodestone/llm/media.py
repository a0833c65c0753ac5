"""Media columns: signature sniffing, type correction and carving.

One Aho-Corasick pass finds magic bytes anywhere in a payload; the validator of
the format then confirms structure and lengths. A confirmed signature at offset
0 decides the type, whatever was declared; confirmed signatures further inside
are carved as embedded media. Texts can be stored losslessly as 8-bit mono PCM
samples in RIFF/WAVE and read back through the same sniffing.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import materialise

FRAME = 576
RATE = 8000


def _riff(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) - at < 12:
        return None
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    kind = bytes(data[at + 8 : at + 12])
    if size < 12 or at + size > len(data):
        return None
    place, seen = at + 12, []
    while place + 8 <= at + size:
        name, length = struct.unpack_from("<4sI", data, place)
        place += 8 + length + (length & 1)
        if place > at + size + 1:
            return None
        seen.append(name)
    if kind == b"WAVE" and b"fmt " in seen and b"data" in seen:
        return "audio/wav", size
    if kind == b"WEBP" and seen and seen[0] in (b"VP8 ", b"VP8L", b"VP8X"):
        return "image/webp", size
    return None


def _png(data: memoryview, at: int) -> tuple[str, int] | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        length, name = struct.unpack_from(">I4s", data, place)
        end = place + 12 + length
        if end > len(data) or first and (name != b"IHDR" or length != 13):
            return None
        if zlib.crc32(data[place + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if name == b"IEND":
            return ("image/png", end - at) if length == 0 else None
        place, first = end, False
    return None


def _gif(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) - at < 13:
        return None
    flags = data[at + 10]
    place = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(place: int) -> int:
        while place < len(data) and data[place]:
            place += data[place] + 1
        return place + 1

    frames = 0
    while place < len(data):
        mark = data[place]
        if mark == 0x3B:
            return ("image/gif", place + 1 - at) if frames else None
        if mark == 0x21:
            place = blocks(place + 2)
        elif mark == 0x2C and place + 10 < len(data):
            local = data[place + 9]
            place = blocks(place + 10 + (3 << ((local & 7) + 1) if local & 128 else 0) + 1)
            frames += 1
        else:
            return None
    return None


@lru_cache(maxsize=1)
def _jpeg_ends(payload: bytes) -> dict[int, tuple[int, bool] | None]:
    """By the place of a segment: where the image ends that goes on there, and whether a frame header follows; filled as segments are met."""
    return {}


def _jpeg(data: memoryview, at: int) -> tuple[str, int] | None:
    payload, known = data.obj, _jpeg_ends(data.obj)
    place, trail, found = at + 2, [], None
    while place + 4 <= len(payload):
        if place in known:
            found = known[place]
            break
        mark, length = payload[place + 1], int.from_bytes(payload[place + 2 : place + 4], "big")
        if payload[place] != 0xFF or mark in (0xD8, 0xD9, 0x00, 0xFF) or length < 2:
            break
        trail.append((place, 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)))
        place += 2 + length
        if mark == 0xDA:
            # Coded data: stuffed bytes and restart marks belong to it.
            place = payload.find(b"\xff", place)
            while 0 <= place < len(payload) - 1 and (payload[place + 1] == 0 or 0xD0 <= payload[place + 1] <= 0xD7):
                place = payload.find(b"\xff", place + 2)
            if place < 0 or place + 1 >= len(payload):
                break
            if payload[place + 1] == 0xD9:
                found = (place + 2, False)
                break
    for spot, frame in reversed(trail):
        found = found and (found[0], found[1] or frame)
        known[spot] = found
    return ("image/jpeg", found[0] - at) if found and found[1] else None


def _bmp(data: memoryview, at: int) -> tuple[str, int] | None:
    if len(data) - at < 26:
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    fits = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels < size <= len(data) - at
    return ("image/bmp", size) if fits else None


STARTXREF = re.compile(rb"startxref\s+(\d{1,18})\s+$")
XREF = re.compile(rb"(\s*)(?:(xref)\b|(\d+)\s+\d+\s+obj\b)")


@lru_cache(maxsize=1)
def _pdf_ends(payload: bytes) -> dict[int, int]:
    """End of the PDF at each start. An end mark belongs to the latest start from which its startxref meets a table or an object.

    A file has a mark for each update; the last one of its own ends it. If none
    is its own (a wrong startxref), the last one that is no other file's does.
    """
    starts, ends, free = np.array([m.start() for m in re.finditer(rb"%PDF-", payload)], np.int64), {}, []
    # A table or an object is met from its first to its last place, those being white space or digits before it.
    met = [(m.start(), m.end(1) if m[2] else m.end(3) - 1, m.end()) for m in XREF.finditer(payload)]
    first, last, done = np.array(met, np.int64).reshape(-1, 3).T
    reached: dict[int, np.ndarray] = {}
    for end in (m.start() for m in re.finditer(rb"%%EOF", payload)):
        owner = None
        if len(met) and (found := STARTXREF.search(payload[max(0, end - 64) : end])):
            offset = min(int(found[1]), len(payload))
            if offset not in reached:
                at = np.searchsorted(first, starts + offset, "right") - 1
                # The place where what a start reaches is over, or the payload's end where it reaches nothing.
                reached[offset] = np.where((at >= 0) & (starts + offset <= last[at]), done[at], len(payload))
            before = reached[offset][: np.searchsorted(starts, end)] <= end
            owner = int(starts[len(before) - 1 - before[::-1].argmax()]) if before.any() else None
        if owner is None:
            free.append(end + 5)
        else:
            ends[owner] = end + 5
    starts = starts.tolist()
    mark = payload.rfind(b"startxref", 0, free[-1]) if free else -1
    for start in starts:
        if start not in ends and mark >= start:
            ends[start] = free[-1]
    return ends


def _pdf(data: memoryview, at: int) -> tuple[str, int] | None:
    end = _pdf_ends(data.obj).get(at)
    return None if end is None else ("application/pdf", end - at)


@lru_cache(maxsize=1)
def _zip_ends(payload: bytes) -> dict[int, int]:
    """End of the archive at each start: an end record says where its directory and so its archive begins; the first that fits a start is its own."""
    ends: dict[int, int] = {}
    for end in (m.start() for m in re.finditer(rb"PK\x05\x06", payload)):
        if end + 22 <= len(payload):
            length, offset, note = struct.unpack_from("<IIH", payload, end + 12)
            start = end - length - offset
            if start >= 0 and payload[start + offset : start + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(payload):
                ends.setdefault(start, end + 22 + note)
    return ends


def _zip(data: memoryview, at: int) -> tuple[str, int] | None:
    end = _zip_ends(data.obj).get(at)
    return None if end is None else ("application/zip", end - at)


def _flac(data: memoryview, at: int) -> tuple[str, int] | None:
    # The stream has no length of its own: a file whose metadata leads to a frame runs to the end of the payload.
    place, first = at + 4, True
    while place + 4 <= len(data):
        kind, length = data[place] & 127, int.from_bytes(data[place + 1 : place + 4], "big")
        if kind == 127 or first and (kind, length) != (0, 34):
            return None
        last, place, first = data[place] >> 7, place + 4 + length, False
        if last:
            fits = place + 2 <= len(data) and data[place] == 0xFF and data[place + 1] & 0xFE == 0xF8
            return ("audio/flac", len(data) - at) if fits else None
    return None


#: Magic bytes of the formats, each with its validator.
MAGIC = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"%PDF-": _pdf,
    b"PK\x03\x04": _zip,
    b"fLaC": _flac,
}


def signature_automaton():
    """Aho-Corasick automaton over the magic bytes, as Latin-1 characters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in MAGIC:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(payload: bytes, automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of confirmed media; what lies inside a confirmed one is still reported."""
    view, found = memoryview(payload), []
    for end, magic in automaton.iter(payload.decode("latin-1")):
        at = end - len(magic) + 1
        if confirmed := MAGIC[magic](view, at):
            found.append((at, confirmed[1], confirmed[0]))
    return found


MEDIA = "declared string, detected string, corrected boolean, embedded array<struct<offset:long,length:long,type:string>>"


def sniff_media(df: DataFrame, payload_col: str, declared_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then declared and detected type, whether that corrects it, and embedded media.

    A null or empty payload, or one that no validator confirms at offset 0, has
    detected type null and keeps what was declared. Rows are independent:
    repeated rows give repeated results, and other columns are not read. Columns
    kept may not be named ``_payload``, ``_declared`` or like those that are added.
    """
    chosen = df.select(*keep, F.col(payload_col).alias("_payload"), F.col(declared_col).alias("_declared"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)]), MEDIA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signature_automaton()
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
        for batch in batches:
            declared, detected, corrected, embedded = batch.column("_declared").to_pylist(), [], [], []
            for i, value in enumerate(batch.column("_payload")):
                found = sniff(value.as_py() or b"", automaton)
                own = next((t for at, _, t in found if at == 0), None)
                detected.append(own)
                corrected.append(own is not None and own != declared[i])
                embedded.append([{"offset": at, "length": n, "type": t} for at, n, t in found if at])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(declared, pa.string()), pa.array(detected, pa.string()), pa.array(corrected), pa.array(embedded, kind)], names=[*keep, "declared", "detected", "corrected", "embedded"])

    return chosen.mapInArrow(run, schema)


def as_wave(content: bytes) -> bytes:
    """RIFF/WAVE, 8-bit mono PCM, whose samples are the content padded with 255 to a positive multiple of 576."""
    payload = content + b"\xff" * (-len(content) % FRAME if content else FRAME)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def wave_samples(data: bytes) -> bytes:
    """The samples of a validated WAVE file."""
    place = 12
    while place + 8 <= len(data):
        name, length = struct.unpack_from("<4sI", data, place)
        if name == b"data":
            return data[place + 8 : place + 8 + length]
        place += 8 + length + (length & 1)
    raise ValueError("no data chunk")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) with the texts stored as WAVE files, written to the shared folder and reread.

    A null text is stored as an empty one. Equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for start in range(0, len(texts), 500):
                part = [t.as_py() or b"" for t in texts.slice(start, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 500), pa.array([len(t) for t in part], pa.int64()), pa.array([as_wave(t) for t in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    stored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return materialise(stored, "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, detected string, embedded int"


def media_features(stored: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Read stored media back: sniffed type, payload digests and signal features, one row per stored row.

    The feature string names the detected type, rate, channels, bits and frames,
    and the samples' mean, root mean square about 128 and zero crossings.
    A file that no validator confirms raises an error: nothing is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signature_automaton()
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                data = value.as_py()
                found = sniff(data, automaton)
                own = next((t for at, n, t in found if at == 0 and n == len(data)), None)
                if own != "audio/wav":
                    raise ValueError(f"stored media not confirmed: {own}")
                payload = wave_samples(data)
                samples = np.frombuffer(payload, np.uint8)
                centred = samples.astype(np.int16) - 128
                crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
                rms = float(np.sqrt(np.dot(centred.astype(np.int64), centred.astype(np.int64)) / len(samples)))
                feature = f"{own};rate={RATE};channels=1;bits=8;frames={len(samples)};mean={int(samples.sum(dtype=np.int64)) / len(samples):.6f};rms={rms:.6f};crossings={crossings}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, own, sum(1 for at, _, _ in found if at)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(columns[i], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))), pa.array([declared] * len(rows), pa.string()), pa.array(columns[6], pa.string()), pa.array(columns[7], pa.int32())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "detected", "embedded"],
            )

    return stored.mapInArrow(run, FEATURES)
