"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

A text slice is one byte array. Prefix sums of mixed bytes times powers of an odd base give the
64-bit rolling hash of any span by one subtraction and one product with the inverse power; words,
lines and, over the words' hashes, n-grams of every length come from the same two sums. Equal
hashes within a document are found by one sort per length, and neighbours in it are compared: words
and lines on their bytes, n-grams on their words. Where unlike spans hash alike (a hash modulo 2 ** 64
has such spans for any base), the run is ordered by its contents instead, so all counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, ragged, small_batches, string_bytes, text_slices

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Shares above which a text is rejected: of word characters in duplicated n-grams (by n) and
    duplicated lines, and of lines. The defaults are those published for a large web corpus."""

    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_chars: float = 0.20
    lines: float = 0.30
    least_words: int = 50
    repeat_words: float = 0.50


def _powers(base: int, n: int) -> np.ndarray:
    known = kept("quality", dict)
    have = known.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    known[base] = have
    return have[:n]


class Rolling:
    """Hashes of spans [a, b) of a sequence of 64-bit values, equal for equal spans."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(BASE, len(values)), out=self.sums[1:])
        self.back = _powers(INVERSE, len(values) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.back[a]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def runs(key: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], content: Callable[[int], object]) -> tuple[np.ndarray, np.ndarray]:
    """Items in an order where equal ones are neighbours, and for each place whether it equals the one before.

    ``key`` is equal for equal items, ``same`` compares items by their contents, which ``content`` gives.
    """
    order = np.argsort(key)
    run = key[order]
    joined = np.zeros(len(run) + 1, bool)  # one more, for the place after the last
    at = np.flatnonzero(run[1:] == run[:-1]) + 1
    joined[at] = same(order[at - 1], order[at])
    for place in np.unique(run[at[~joined[at]]]) if len(at) else ():
        low, high = np.searchsorted(run, place), np.searchsorted(run, place, side="right")
        items = sorted((content(i), i) for i in order[low:high].tolist())
        order[low:high] = [i for _, i in items]
        joined[low + 1 : high] = [x[0] == y[0] for x, y in zip(items, items[1:], strict=False)]
    return order, joined


def repeats(order: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of items that equal another (see ``runs``), and of those that equal an earlier one."""
    later, found = np.zeros(len(order), bool), np.zeros(len(order), bool)
    found[order] = joined[:-1] | joined[1:]
    if len(order):
        starts = np.flatnonzero(~joined[:-1])
        later[order] = True
        later[np.minimum.reduceat(order, starts)] = False
    return found, later


class Bytes:
    """Spans [start, end) of one byte array, compared and taken as such."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.raw, self.start, self.end = raw, start, end

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = self.end[i] - self.start[i]
        equal = size == self.end[j] - self.start[j]
        a, b, size = self.start[i[equal]], self.start[j[equal]], size[equal]
        unlike = np.repeat(np.arange(len(size)), size)[self.raw[ragged(a, size)] != self.raw[ragged(b, size)]]
        alike = np.ones(len(size), bool)
        alike[unlike] = False
        equal[equal] = alike
        return equal

    def content(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def numbered(spans: Bytes, key: np.ndarray) -> np.ndarray:
    """A number per span, the same for spans of equal bytes only; ``key`` are their hashes."""
    order, joined = runs(key, spans.same, spans.content)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(~joined[:-1])
    return number


def in_document(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of items of one document differ from those of another's (by chance they may not: ``same`` tells)."""
    return key + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a flagged window of ``width`` items."""
    at = np.flatnonzero(flags)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(raw: np.ndarray, off: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """The counts and shares of each text raw[off[i] : off[i + 1]]."""
    docs, size = len(off) - 1, len(raw)
    total = lambda index, weight=None: np.bincount(index, weight, docs)
    inside = ~SPACE[raw]
    first = np.zeros(size + 1, bool)
    first[off] = True
    before = np.concatenate([[False], inside])
    starts = np.flatnonzero(inside & (~before[:-1] | first[:-1]))
    last = np.concatenate([inside, [False]])
    ends = np.flatnonzero(inside & (~last[1:] | first[1:])) + 1
    points = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & inside)])
    rolling = Rolling(MIX[raw])
    doc = np.searchsorted(off, starts, side="right") - 1
    n_words = total(doc).astype(np.int64)
    chars = points[ends] - points[starts]
    out = {"n_words": n_words, "word_chars": points[off[1:]] - points[off[:-1]]}
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[raw])])
    out["n_symbols"] = symbols[off[1:]] - symbols[off[:-1]]

    breaks = np.flatnonzero(raw == 10)
    line_start = np.union1d(breaks + 1, off[:-1][off[:-1] < off[1:]])
    line_start = line_start[line_start < size]
    line_doc = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.minimum(np.append(breaks, size)[np.searchsorted(breaks, line_start)], off[line_doc + 1])
    words = points[line_end] - points[line_start]
    line_start, line_end, line_doc, words = (x[words > 0] for x in (line_start, line_end, line_doc, words))
    whole = Bytes(raw, line_start, line_end)
    _, again = repeats(*runs(in_document(rolling.of(line_start, line_end), line_doc), lambda i, j: (line_doc[i] == line_doc[j]) & whole.same(i, j), lambda i: (int(line_doc[i]), whole.content(i))))
    lines = total(line_doc)
    out["n_lines"] = lines.astype(np.int64)
    out["n_dup_lines"] = total(line_doc[again]).astype(np.int64)
    word_chars = np.maximum(out["word_chars"], 1)
    out["dup_line_chars"] = total(line_doc[again], words[again]) / word_chars

    word = numbered(Bytes(raw, starts, ends), rolling.of(starts, ends))
    tokens = Rolling(word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(BASE))
    n, at = len(starts), np.arange(len(starts))
    for width in (3, *limits.ngram_chars):
        i = at[: max(0, n - width + 1)]
        i = i[doc[i] == doc[i + width - 1]]
        own = doc[i]

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            equal = own[a] == own[b]  # noqa: B023
            for k in range(width):  # noqa: B023
                equal &= word[i[a] + k] == word[i[b] + k]  # noqa: B023
            return equal

        found, later = repeats(*runs(in_document(tokens.of(i, i + width), own), same, lambda x: (int(own[x]), *word[i[x] : i[x] + width].tolist())))  # noqa: B023
        flags = np.zeros(n, bool)
        if width == 3:
            flags[i[found]] = True
            out["n_repeat_words"] = total(doc[covered(flags, 3, n)]).astype(np.int64)
        if width in limits.ngram_chars:
            flags[:] = False
            flags[i[later]] = True
            hit = covered(flags, width, n)
            out[f"dup_{width}gram_chars"] = total(doc[hit], chars[hit]) / word_chars
    return out


def quality(docs: DataFrame, limits: Limits | None = None, key: str = "doc_id") -> DataFrame:
    """Counts, coverage shares and the verdict for every row of docs (key, text).

    A null or empty text has no words and fails the base rule. Rows with equal or null keys are
    measured each for itself; further columns of docs are ignored; no rows give no rows.
    """
    limits = limits or Limits()
    small_batches(docs.sparkSession)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_chars", *[f"dup_{w}gram_chars" for w in limits.ngram_chars]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 2 << 20):
            m = measure(*string_bytes(part.column("text")), limits)
            failed = (m["n_words"] < limits.least_words) | (m["n_repeat_words"] > limits.repeat_words * m["n_words"])
            bad = (m["dup_line_chars"] > limits.line_chars) | (m["n_dup_lines"] > limits.lines * m["n_lines"])
            for width, most in limits.ngram_chars.items():
                bad |= m[f"dup_{width}gram_chars"] > most
            columns = [part.column(key), *[pa.array(m[c].astype(np.int64)) for c in counts], pa.array(failed), pa.array(~failed & ~bad), *[pa.array(m[c]) for c in shares]]
            yield pa.RecordBatch.from_arrays(columns, [key, *counts, "base_failed", "kept", *shares])

    schema = f"{key} long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in shares)
    return docs.selectExpr(f"cast({key} as long) {key}", "cast(text as string) text").mapInArrow(run, schema)
