"""Texts to token ids by way of split pieces, a batch of texts at a time.

A word-level tokenizer's splitter looks at character classes only, so a whole
batch is cut in numpy: code points to classes, class changes to piece starts.
Pieces stay in Arrow: the distinct ones of a batch are looked up in a table of
those seen before, new ones are resolved by the caller, and the ids of all
occurrences are gathered at once. Nothing is done per word in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The tokenizers' split pattern, its white space, and the ends that it cuts off after an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Ranges whose characters' classes and compositions agree in all Unicode versions in use; other texts take the library's own steps.
SETTLED = [(0x00, 0x24F), (0x370, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20AC, 0x20AC), (0x3000, 0x3098), (0x309B, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points of a batch: what one call holds in memory.
BATCH_POINTS = 3_000_000
#: The same for a run of a column, whose worker also holds the column, the ids and the decoded texts.
RUN_POINTS = 1_000_000
#: Marks a piece that stands for one special token; no UTF-8 text holds this byte.
SPECIAL = b"\xff"


def _class_table() -> np.ndarray:
    table = np.full(1 << 16, OTHER, np.uint8)
    for first, last in SETTLED:
        for point in range(first, last + 1):
            # Some composed or lower-case forms leave the ranges.
            for c in unicodedata.normalize("NFC", chr(point)).lower():
                table[ord(c)] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
    table[SPACES] = SPACE
    return table


_TABLE: list[np.ndarray] = []


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(pieces as a binary array, number of pieces of each text) of normalised texts of settled characters."""
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    kind = _TABLE[0][points]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    mark = np.flatnonzero((points == ord("'")) & start)
    if len(mark):
        # An apostrophe that starts a piece takes one of the ends with it; the last point is a blank, so what follows exists.
        one = points[mark + 1]
        two = points[np.minimum(mark + 2, len(points) - 1)]
        width = np.zeros(len(mark), np.int64)
        for end in ENDS:
            width[(one == ord(end[0])) & (len(end) == 1 or two == ord(end[-1]))] = len(end) + 1
        mark, width = mark[width > 0], width[width > 0]
        start[mark + 1] = False
        after = mark + width
        start[after[kind[after] == LETTER]] = True
    before = np.concatenate(([0], np.cumsum(start, dtype=np.int64)))
    begin = np.cumsum(sizes) - sizes
    counts = before[begin + sizes] - before[begin]
    inked = kind != SPACE
    kept = points[inked]
    first = np.flatnonzero(start[inked])
    if len(kept) and kept.max() >= 0x80:
        data = kept.tobytes().decode("utf-32-le").encode()
        width = 1 + (kept >= 0x80).astype(np.int32) + (kept >= 0x800) + (kept >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(width)))[np.append(first, len(kept))].astype(np.int32)
    else:
        data = kept.astype(np.uint8).tobytes()
        offsets = np.append(first, len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]), counts


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one range after the other."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


class PieceTable:
    """Pieces and their ids, at most about ``most`` of them: those met in one batch only go first."""

    def __init__(self, kind: str, most: int):
        self.kind, self.most = kind, most
        self._keep(None)

    def _keep(self, which: np.ndarray | None) -> None:
        if which is None:
            self.keys, self.begin, self.size, self.ids = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        else:
            self.ids = self.ids[ranges(self.begin[which], self.size[which])]
            self.keys, self.size = self.keys.take(pa.array(which)), self.size[which]
            self.begin = np.cumsum(self.size) - self.size
        self.met = np.zeros(len(self.size), np.int32)

    def places(self, pieces: pa.Array, resolve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Place of each of some distinct pieces; ``resolve`` gives (ids of all, number of ids of each) for new ones."""
        if len(self.size) > self.most:
            often = np.flatnonzero(self.met > 1)
            self._keep(often if len(often) <= self.most // 2 else None)
        found = pc.index_in(pieces, value_set=self.keys)
        if found.null_count:
            new = pieces.filter(pc.is_null(found))
            ids, size = resolve(new.to_pylist())
            self.keys = pa.concat_arrays([self.keys, new])
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(size) - size))
            self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids.astype(self.kind)))
            self.met = np.concatenate((self.met, np.zeros(len(size), np.int32)))
            at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at[at < 0] = np.arange(len(self.size) - len(size), len(self.size))
        else:
            at = found.to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[at] += 1
        return at


def encode(units: list[list[str | list[bytes]]], table: PieceTable, resolve) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's ids).

    A text is a list of units: normalised settled text to be split here, or a
    list of pieces that somebody else has split.
    """
    flat = [u for parts in units for u in parts]
    texts = [u for u in flat if isinstance(u, str)]
    pieces, counts = split(texts)
    if len(texts) < len(flat):
        others = [u for u in flat if not isinstance(u, str)]
        size = np.zeros(len(flat), np.int64)
        plain = np.fromiter((isinstance(u, str) for u in flat), bool, len(flat))
        size[plain], size[~plain] = counts, [len(u) for u in others]
        begin = np.zeros(len(flat), np.int64)
        begin[plain] = np.cumsum(counts) - counts
        begin[~plain] = len(pieces) + np.cumsum(size[~plain]) - size[~plain]
        pieces = pa.concat_arrays([pieces, pa.array([p for u in others for p in u], pa.binary())]).take(pa.array(ranges(begin, size)))
        counts = size
    coded = pieces.dictionary_encode()
    at = table.places(coded.dictionary, resolve)[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
    size = table.size[at]
    ids = table.ids[ranges(table.begin[at], size)]
    # Pieces before each unit, units before each text, ids before each piece.
    units_before = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))))
    pieces_before = np.concatenate(([0], np.cumsum(counts)))[units_before]
    return ids, np.concatenate(([0], np.cumsum(size)))[pieces_before]


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of bounded size; a text of more than that is a run of its own."""
    return _cuts(map(len, texts), BATCH_POINTS)


def runs(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, texts) of runs of an Arrow column without nulls: one run at a time becomes Python's strings."""
    for start, stop in _cuts(pc.utf8_length(texts).to_numpy(zero_copy_only=False).tolist(), RUN_POINTS):
        yield start, stop, texts.slice(start, stop - start).to_pylist()


def _cuts(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    start = stop = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held, stop = held + size, i + 1
    if start < stop:
        yield start, stop


def unsettled_pattern():
    import re

    return re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SETTLED) + "]")


def normalised(text: str) -> str:
    """NFC and lower case, each character by itself as the tokenizer does; for settled texts."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()
