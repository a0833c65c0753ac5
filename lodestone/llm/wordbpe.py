"""Exact encoding and decoding for a word-level BPE with end-of-word marks.

Frequent words are compiled, with their token ids, into a minimal acyclic
transducer: equal suffixes share states, and the number of words below each
state turns a path into the word's index. The automaton is a flat file that
workers memory-map. Words that it doesn't hold are merged exactly by rank,
many at a time in numpy, very long ones with a heap. Results are remembered
within a bound.
"""

from __future__ import annotations

import functools
import heapq
import json
import mmap
import os
import re
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm import pieces
from lodestone.llm.pieces import PATTERN, SPECIAL

#: Words of more bytes are merged one by one with a heap, in time n log n.
LONG_WORD = 192
_UNSETTLED = pieces.unsettled_pattern()

def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Vocabulary and merges of a tokenizer file, with the steps that come before and after them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model.get("ignore_merges"):
            raise ValueError("not a tokenizer of the kind that is implemented here")
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError("another split pattern")
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.size = len(self.tokens)
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        #: One more than the ids, so that a pair with nothing (-1) has a key of its own.
        self.base = self.size + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), np.append(made, 0).astype(np.int32)
        # A table of the first merge at or after a hash of the pair: one gather instead of a binary search.
        self.none = len(pairs)
        self.slots = 1 << 18
        self.table_key = np.full(self.slots, -1, np.int64)
        self.table_at = np.full(self.slots, -1, np.int64)
        self.probes = 1
        for at, k in enumerate(self.keys.tolist()):
            slot, tries = self._slot(k), 1
            while self.table_key[slot] != -1:
                slot, tries = (slot + 1) % self.slots, tries + 1
            self.table_key[slot], self.table_at[slot] = k, at
            self.probes = max(self.probes, tries)
        self.path, self.library, self.byte_of, self.by_pair = path, None, {c: b for b, c in enumerate(chars)}, None

    def library_pieces(self, text: str) -> list[bytes]:
        """Split pieces of a text by the library's normaliser and splitter."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in pieces]

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 12) % self.slots

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, which makes the token ``made[rank]``; ``none`` where there is no merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.full(len(key), -1, np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        for _ in range(self.probes):
            held = self.table_key[slot]
            hit = held == key[todo]
            at[todo[hit]] = self.table_at[slot[hit]]
            more = ~hit & (held != -1)
            todo = todo[more]
            if not len(todo):
                break
            slot = (slot[more] + 1) % self.slots
        return np.where(at >= 0, self.ranks[at], self.none).astype(np.int32)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) of split words (UTF-8, not empty), merged exactly by rank, leftmost first."""
        out: list = [None] * len(words)
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(by_size):
            width, stop = len(words[by_size[start]]), start
            if width > LONG_WORD:
                for i in by_size[start:]:
                    out[i] = self._merge_long(words[i])
                break
            while stop < len(by_size) and len(words[by_size[stop]]) <= width + 1 and (stop - start) * width < 400_000:
                stop += 1
            self._merge_block(words, by_size[start:stop], out)
            start = stop
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.fromiter(map(len, out), np.int64, len(out))

    def _merge_block(self, words: list[bytes], which: list[int], out: list) -> None:
        """Words of about one length, a row each: every step merges the best pair of each row, so that all rows lose one place."""
        sizes = np.array([len(words[i]) for i in which])
        width, count = int(sizes.max()), len(which)
        flat = np.frombuffer(b"".join(words[i] for i in which), np.uint8)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(count), sizes)
        place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        ids = np.full((count, width), -1, np.int32)
        ids[owner, place] = self.inner[flat]
        ids[np.arange(count), sizes - 1] = self.last[flat[ends - 1]]
        # A shorter row ends with -1, and no merge has that.
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, width - 1)
        live, left = np.array(which), sizes
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            best = rank[rows, at]
            going = best < self.none
            if not going.all():
                for i in np.flatnonzero(~going):
                    out[live[i]] = ids[i, : left[i]]
                if not going.any():
                    return
                live, left, ids, rank, at, best = live[going], left[going], ids[going], rank[going], at[going], best[going]
                rows = np.arange(len(live))
            ids[rows, at] = self.made[best]
            stay = np.ones(ids.shape, bool)
            stay[rows, at + 1] = False
            ids = ids[stay].reshape(len(live), -1)
            stay = np.ones(rank.shape, bool)
            stay[rows, at] = False
            rank = rank[stay].reshape(len(live), -1)
            left = left - 1
            for spot in (at - 1, at):
                ok = (spot >= 0) & (spot < rank.shape[1])
                r, s = rows[ok], spot[ok]
                rank[r, s] = self.pair_ranks(ids[r, s], ids[r, s + 1])
        for i, n in enumerate(left):
            out[live[i]] = ids[i, :n]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word by a heap of pairs and linked neighbours; the same merges in the same order."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        made, find, size = self.made.tolist(), self.by_pair.get, self.base
        heap = [(r, i) for i in range(n - 1) if (r := find(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # An entry is stale if either neighbour has changed since: then the pair's rank is another.
            if ids[i] < 0 or j < 0 or find(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := find(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := find(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (s, h))
        return np.array([i for i in ids if i >= 0], np.int32)


# The lexicon ------------------------------------------------------------------

MAGIC = b"LXA1"


def build_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of byte words with id outputs, as one flat file.

    Built in sorted order; a state is frozen when the next word leaves it, and a
    frozen state equal to an earlier one is replaced by it. Arcs are kept as
    sorted keys ``state * 256 + byte`` with their target and the number of words
    that come before through smaller arcs; summed along a path they give the
    word's index into the table of outputs.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    counts: list[int] = []
    finals: list[bool] = []

    def freeze(node: list) -> int:
        form = (node[0], tuple(node[1]))
        if (found := register.get(form)) is not None:
            return found
        arcs_of.append(form[1])
        finals.append(node[0])
        counts.append(int(node[0]) + sum(counts[t] for _, t in form[1]))
        register[form] = len(arcs_of) - 1
        return len(arcs_of) - 1

    path: list[list] = [[False, []]]
    before = b""
    for word in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        for depth in range(len(before), same, -1):
            state = freeze(path.pop())
            path[-1][1].append((before[depth - 1], state))
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        before = word
    for depth in range(len(before), 0, -1):
        state = freeze(path.pop())
        path[-1][1].append((before[depth - 1], state))
    root = freeze(path.pop())
    keys, target, skipped = [], [], []
    for state, arcs in enumerate(arcs_of):
        passed = int(finals[state])
        for label, to in arcs:
            keys.append(state * 256 + label)
            target.append(to)
            skipped.append(passed)
            passed += counts[to]
    ids = [entries[w] for w in words]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    parts = [np.array(keys, np.int64), np.array(target, np.int64), np.array(skipped, np.int64), np.array(finals, np.int64), starts, np.array([i for x in ids for i in x], np.int64)]
    return MAGIC + struct.pack("<I", root) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a lexicon")
        (self.root,) = struct.unpack_from("<I", data, 4)
        at, parts = 56, []
        for n in struct.unpack_from("<6Q", data, 8):
            parts.append(np.frombuffer(data, np.int64, n, at))
            at += 8 * n
        self.keys, self.target, self.skipped, self.final, self.starts, self.ids = parts

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Map the bytes from an unlinked file of this process's own temporary folder: workers share no heap copy of the arrays."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word (not empty), or -1; all words walk the automaton together."""
        count = len(words)
        found = np.full(count, -1, np.int64)
        if not count or not len(self.keys):
            return found
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, index, live = np.full(count, self.root, np.int64), np.zeros(count, np.int64), np.arange(count)
        depth = 0
        while len(live):
            key = state * 256 + flat[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, index = self.target[at], index[ok] + self.skipped[at]
            depth += 1
            done = sizes[live] == depth
            hit = done & (self.final[state] == 1)
            found[live[hit]] = index[hit]
            live, state, index = live[~done], state[~done], index[~done]
        return found

    def outputs(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of some words."""
        size = self.starts[index + 1] - self.starts[index]
        return self.ids[pieces.ranges(self.starts[index], size)], size


class Encoder:
    """Texts to ids. ``lexicon`` holds split pieces; None leaves every piece to the merges."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon | None = None, remember: int = 250_000):
        self.bpe, self.lexicon = bpe, lexicon
        self.table = pieces.PieceTable("<u4", remember)
        self.tokens = pa.array(bpe.tokens, pa.string())
        self.special = re.compile("|".join(re.escape(s) for s in sorted(bpe.special, key=len, reverse=True))) if bpe.special else None

    def resolve(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: special ones by name, those of the lexicon from it, all others by the merges."""
        size = np.zeros(len(new), np.int64)
        begin = np.zeros(len(new), np.int64)
        parts, held = [], 0

        def put(which: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
            nonlocal held
            size[which], begin[which] = count, held + np.cumsum(count) - count
            parts.append(ids)
            held += len(ids)

        marked = np.fromiter((p.startswith(SPECIAL) for p in new), bool, len(new))
        if marked.any():
            which = np.flatnonzero(marked)
            put(which, np.array([self.bpe.special[new[i][1:].decode()] for i in which]), np.ones(len(which), np.int64))
        rest = np.flatnonzero(~marked)
        if self.lexicon is not None and len(rest):
            index = self.lexicon.find([new[i] for i in rest])
            put(rest[index >= 0], *self.lexicon.outputs(index[index >= 0]))
            rest = rest[index < 0]
        if len(rest):
            put(rest, *self.bpe.merge_words([new[i] for i in rest]))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return ids[pieces.ranges(begin, size)], size

    def units(self, text: str) -> list[str | list[bytes]]:
        parts: list[str | list[bytes]] = []

        def add(segment: str) -> None:
            plain = segment.isascii() or not _UNSETTLED.search(segment)
            parts.append(pieces.normalised(segment) if plain else self.bpe.library_pieces(segment))

        at = 0
        if self.special is not None and "<|" in text:
            for m in self.special.finditer(text):
                add(text[at : m.start()])
                parts.append([SPECIAL + m[0].encode()])
                at = m.end()
        add(text[at:] if at else text)
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit integers, offsets of each text's ids); call with texts of bounded size together."""
        return pieces.encode([self.units(t) for t in texts], self.table, self.resolve)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for start, stop in pieces.batches(texts):
            ids, offsets = self.encode(texts[start:stop])
            out += [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return out

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Tokens of each text separated by blanks: the tokenizer has no decoder step that would join them."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.tokens.take(pa.array(ids))), " ")

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_batch(ids, np.array([0, len(ids)]))[0].as_py()


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, lexicon: bytes | None) -> Encoder:
    """The encoder of this worker process: what it remembers serves the tasks that follow."""
    return Encoder(WordBPE(path), None if lexicon is None else Lexicon.mapped(lexicon))


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
