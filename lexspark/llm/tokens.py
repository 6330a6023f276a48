"""Encoding with the ``tokenizers`` library, a chunk of text at a time.

Both vocabularies split a text before they merge, and never across white space that follows
something else. So a text's ids are those of its chunks in turn, and each different chunk is
encoded by the library once while a worker knows it. A text for which that need not hold (white
space outside ASCII, the string of a special token) goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import kept, ragged, string_bytes

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Fixed by Unicode: white space other than ASCII's, and four control characters, in UTF-8.
ODD_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
CACHE_ENTRIES = 1_000_000
CACHE_BYTES = 64 << 20  # of long chunks and of ids; what one call adds comes on top
_FIRST_BYTES = (np.uint64(1) << (np.arange(9, dtype=np.uint64) * np.uint64(8) % np.uint64(64))) - np.uint64(1)
_FIRST_BYTES[8] = np.uint64(2**64 - 1)


def chunk_bounds(raw: np.ndarray, off: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of the texts raw[off[i] : off[i + 1]].

    A chunk is a run without white space, with the white space before it if ``keep_space``.
    """
    space, n = SPACE[raw], len(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[True], space[:-1]])[:n]
    if keep_space:
        starts = np.flatnonzero(edge[:-1] | (space & ~before))
        return starts, np.append(starts[1:], n)[: len(starts)]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.concatenate([space[1:], [True]])[:n]
    return starts, np.flatnonzero(~space & (after | edge[1:])) + 1


class ChunkTable:
    """Numbers different byte strings as they come: an open hash table in arrays.

    Strings of up to 24 bytes are kept and compared as three words and a length, longer ones in a dictionary.
    """

    def __init__(self, bits: int = 22):
        self.mask = (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.words = np.zeros((4, 1 << 14), np.uint64)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.n = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        h = key[0] * np.uint64(0x9E3779B97F4A7C15) ^ key[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (key[2] + key[3]) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64) if self.mask < 1 << 24 else (h & np.uint64(self.mask)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of known keys, else -1."""
        slot = self._slot(key)
        out = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[(self.words[:, out[open_]] != key[:, open_]).any(0)]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.slots[slot[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[(self.words[:, out[open_]] != key[:, open_]).any(0)]
        return out

    def _insert(self, key: np.ndarray, number: np.ndarray) -> None:
        slot, left = self._slot(key), np.arange(key.shape[1])
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            self.slots[slot[free[first]]] = number[free[first]]
            placed = np.zeros(key.shape[1], bool)
            placed[free[first]] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the strings raw[start:end], and those that are new, in the order of their numbers."""
        padded = np.concatenate([raw, np.zeros(32, np.uint8)])
        view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        size = ends - starts
        out, new = np.full(len(starts), -1, np.int64), []
        short = np.flatnonzero(size <= 24)
        s, n = starts[short], size[short]
        key = np.stack([*(view[np.minimum(s + at, len(raw))] & _FIRST_BYTES[np.clip(n - at, 0, 8)] for at in (0, 8, 16)), n.astype(np.uint64)])
        found = self._find(key)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            order = miss[np.lexsort(key[:, miss])]
            lead = np.concatenate([[True], (key[:, order[1:]] != key[:, order[:-1]]).any(0)])
            number = self.n + np.cumsum(lead) - 1
            found[order] = number
            self._grow(int(lead.sum()))
            ones = order[lead]
            self.words[:, self.n : self.n + len(ones)] = key[:, ones]
            self._insert(key[:, ones], number[lead].astype(np.int32))
            self.n += len(ones)
            new += [raw[a:b].tobytes() for a, b in zip(s[ones].tolist(), (s + n)[ones].tolist(), strict=True)]
        out[short] = found
        for i in np.flatnonzero(size > 24).tolist():
            text = raw[starts[i] : ends[i]].tobytes()
            if (at := self.long.get(text)) is None:
                self._grow(1)
                at = self.long[text] = self.n
                self.long_bytes += len(text) + 128
                self.n += 1
                new.append(text)
            out[i] = at
        return out, new

    def _grow(self, more: int) -> None:
        while self.n + more > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)


class ChunkEncoder:
    """Ids of whole texts through a bounded cache of chunks.

    ``space`` says what the vocabulary does with white space ("drop" or "keep"). A cache that is full, by
    entries or by bytes, starts anew between two calls, so memory stays bounded and results don't depend on it.
    """

    def __init__(self, path: str, space: str, entries: int = CACHE_ENTRIES, most_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.lib.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join([ODD_SPACE, *special]))
        odd = [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, *(t.content.encode()[0] for t in self.lib.get_added_tokens_decoder().values())]
        self.suspect = np.zeros(256, bool)
        self.suspect[odd] = True
        self.keep = space == "keep"
        self.entries, self.most_bytes = entries, most_bytes
        self.table = ChunkTable()
        self._clear()

    @classmethod
    def shared(cls, path: str, space: str) -> ChunkEncoder:
        """A worker's own encoder of this vocabulary."""
        return kept(("encoder", path, space), lambda: cls(path, space))

    def _clear(self) -> None:
        self.table.clear()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.end = np.zeros(1 << 14, np.int64)  # where chunk i ends in the pool, at i + 1

    def _learn(self, new: list[bytes], base: int) -> None:
        ids = [e.ids for e in self.lib.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in ids]) + self.end[base]
        while base + len(new) + 1 > len(self.end):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.end[base + 1 : base + 1 + len(new)] = ends
        self.pool[self.end[base] : ends[-1]] = np.fromiter((i for x in ids for i in x), np.uint32, int(ends[-1] - self.end[base]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids in one array of uint32, and where each text's ids start in it; a null is empty."""
        if self.table.n > self.entries or self.table.long_bytes + self.pool.nbytes > self.most_bytes:
            self._clear()
        raw, off = string_bytes(column)
        starts, ends = chunk_bounds(raw, off, self.keep)
        base = self.table.n
        which, new = self.table.numbers(raw, starts, ends)
        if new:
            self._learn(new, base)
        first = self.end[which]
        size = self.end[which + 1] - first
        ids = self.pool[ragged(first, size)]
        bounds = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, off)]
        if self.suspect[raw].any() and (odd := sorted({int(np.searchsorted(off, m.start(), side="right")) - 1 for m in self.whole.finditer(raw.tobytes())})):
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in odd:
                parts[i] = np.array(self.lib.encode(raw[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds
