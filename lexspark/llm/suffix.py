"""Repeated byte strings across documents, from Burrows-Wheeler transforms of the places that share anchors.

Every string of ``length`` bytes has an anchor: the smallest of its ``GRAM``-byte hashes. A run of
neighbouring strings whose anchor is in one place is a segment, and equal strings lie in segments with equal
anchors. So documents are cut into segments, which meet by anchor. Of equal segments all but the earliest
are repeats as they stand. Of different ones only those that share what is before or after their anchor
can have a string in common, and only these get their texts.

Of the texts that meet, a task builds suffix ranks and the transform's LF mapping and expands
intervals breadth-first: an interval holds the suffixes that begin with one string, a backward
step of ``STEP`` bytes maps it to the intervals of the strings that are longer by the bytes before.
Common prefixes are so found by increasing length, and expansion stops at the minimum length.
Intervals of one suffix end early. What is left are the repeated strings; in each, all
occurrences but the earliest are removed.

The segments of a very frequent anchor (a line that a third of all texts hold) don't meet in one task. They are
cut into parts, by how far before the anchor a string starts; the bytes that all strings of a part share, nearly
``length`` of them, are its anchor then. Parts that are still frequent are cut into their strings. Equal strings
are cut alike, so nothing else changes: parts are segments, of which equal ones are repeats and different ones
meet if they share their anchor. A sample of the rows tells what is frequent, HEAVY anchors and HEAVY parts at
most; the sample decides on routes only, never on results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, keyed, materialize, ragged, small_batches, string_bytes, text_slices

LENGTH = 100
GRAM = 30
STEP = 10
#: Bytes of segment texts in one transform, about; the segments of an anchor, or of a block of it, stay together.
INDEX_BYTES = 1 << 18
#: One row in SAMPLE is looked at for anchors with FREQUENT different segments or more in that sample.
SAMPLE, FREQUENT, HEAVY = 64, 8, 10_000
#: The strings of a segment of a frequent anchor in one part; a part of BLOCK different ones, about, is cut into strings.
PART, BLOCK = 9, 256
MIX = np.random.default_rng(20260303).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = kept("suffix", dict)
    have = known.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(int(base), len(have), 1 << 64))])
    known[base] = have
    return have[:n]


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Spans:
    """Rolling hashes of byte spans, by prefix sums. Two spans that hash alike by chance only meet for nothing."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(MIX[raw] * _powers(BASE, len(raw)), out=self.sums[1:])
        self.back = _powers(INVERSE, len(raw) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _finish((self.sums[b] - self.sums[a]) * self.back[a])

    def every(self, width: int) -> np.ndarray:
        return _finish((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def _cut(start: np.ndarray, n: np.ndarray, core: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Parts of segments in order: which segment's, start, number of strings, and where what all strings of the part share begins.

    A part's strings start from k * ``width`` to (k + 1) * ``width`` - 1 bytes before the segment's core.
    """
    far = core - start
    many = far // width - (far - n + 1) // width + 1
    of = np.repeat(np.arange(len(start)), many)
    own = core[of] + width * ragged(-(far // width), many)
    a, b = np.maximum(start[of], own - width + 1), np.minimum(start[of] + n[of] - 1, own)
    return of, a, b - a + 1, own


def segments(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, frequent: tuple[list[int], ...] = (), parts: bool = False) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, start in ``raw``, number of strings and sides of each segment of the texts.

    A segment of n strings is the bytes from its start to start + n + length - 1; its content hash is XXH3 of
    these. Its sides are two 16-bit hashes, of the anchor with half the other bytes of a string before
    it, and after it (0: no string of the segment has these whole). A string has one of the two whole, so segments with a
    string in common have a side in common. Segments count as equal if both hashes, the sides and
    the lengths agree, 160 bits of two unlike families of hashes (128 for a single string).

    ``frequent``: anchors of segments that are cut into parts, and then those of parts that are cut into
    strings; ``parts``: return those of the last cut only.
    """
    none = (*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)
    many = np.maximum(np.diff(off) - length + 1, 0)
    if not many.sum():
        return none
    # Smallest by the hash's upper half, then leftmost: equal strings have their anchors in the same
    # place, and a segment has one, so it can't hold a string twice.
    spans = Spans(raw)
    hashes = spans.every(gram)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while span < width:  # least[i]: of the grams from i to i + span - 1
        more = min(span, width - span)
        least = np.minimum(least[:-more], least[more:])
        span += more
    at = ragged(off[:-1], many)
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, core = at[first], place[first]
    anchor, size = hashes[core], np.full(len(first), gram)
    last = np.ones(len(first), bool)
    for keys, width in zip(frequent, (min(PART, length - gram + 1), 1), strict=False):
        cut = last.copy()
        cut[last] = np.isin(anchor[last].view(np.int64), np.array(keys, np.int64))
        of, a, m, own = _cut(start[cut], n[cut], core[cut], width)
        order = np.argsort(np.concatenate([start[~cut], a]), kind="stable")
        left, shared = int((~cut).sum()), np.full(len(a), length + 1 - width)
        anchor = np.concatenate([anchor[~cut], spans.of(own, own + shared)])[order]
        start, n, core, size = (np.concatenate([x[~cut], y])[order] for x, y in ((start, a), (n, m), (core, own), (size, shared)))
        last = order >= left
    if parts:
        anchor, start, n, core, size = (x[last] for x in (anchor, start, n, core, size))
    doc = np.searchsorted(off, start, side="right") - 1
    half = -(-(length - size) // 2)
    a, b = np.maximum(core - half, 0), np.minimum(core + size + half, len(raw))
    far = core - start
    before = np.where((far >= half) & (core - half >= off[doc]), spans.of(a, core + size) % np.uint64(65535) + np.uint64(1), 0)
    after = np.where((far - n + 1 <= length - size - half) & (core + size + half <= off[doc + 1]), spans.of(core, b) % np.uint64(65535) + np.uint64(1), 0)
    sides = (before.astype(np.int64) << 16) | after.astype(np.int64)
    text, hashed = raw.tobytes(), xxhash.xxh3_64_intdigest
    content = np.fromiter((hashed(text[i:j], 42) for i, j in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)), np.uint64, len(start))
    return anchor, content, start, n, sides


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys, equal for equal ones, and the order that sorts them."""
    order = np.argsort(key)
    run = key[order]
    number = np.zeros(len(run), np.int32)
    np.cumsum(run[1:] != run[:-1], out=number[1:], dtype=np.int32)
    rank = np.empty(len(run), np.int32)
    rank[order] = number
    return rank, order


def _from(values: np.ndarray, shift: int) -> np.ndarray:
    """values[i + shift], and 0 beyond the end."""
    out = np.zeros_like(values)
    if shift < len(values):
        out[: len(values) - shift] = values[shift:]
    return out


def heads(text: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Each suffix's first symbols as one number, how many these are, and the bits of one: as many as fit 63 bits.

    Symbols are numbered densely from 1, in their order; 0 stands beyond the end.
    """
    used = np.flatnonzero(np.bincount(text))
    code = np.zeros(int(used[-1]) + 1, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    bits = len(used).bit_length()
    head, width, most = code[text], 1, 63 // bits
    while width < most:
        more = min(width, most - width)
        head = (head << (bits * more)) | (_from(head, width) >> (bits * (width - more)))
        width += more
    return head, width, bits


def suffix_ranks(head: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each suffix by its first ``depth`` symbols at least, suffixes in that order).

    Ranks by more symbols, up to twice as many, follow from those at two places.
    """
    rank, order = _ranked(head)
    while width < depth:
        more = min(width, depth - width)
        rank, order = _ranked(rank.astype(np.int64) * (len(head) + 2) + _from(rank + 1, more))
        width += more
    return rank, order


def repeated(text: np.ndarray, length: int = LENGTH, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions of strings of ``length`` symbols that repeat, and the interval that each is in.

    Symbol 0 ends a segment and is in no string. ``step`` divides ``length``.
    """
    n = len(text)
    head, width, bits = heads(text)
    _, sa = suffix_ranks(head, width, length)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    # The transform: what stands before each sorted suffix; a step is ``step`` symbols at once.
    lf = np.zeros(n, np.int32)
    lf[step:] = place[: max(n - step, 0)]
    ended = np.concatenate([[0], np.cumsum(text == 0, dtype=np.int32)])
    can = np.zeros(n, bool)
    can[step:] = ended[step:n] == ended[: n - step]
    lf, can = lf[sa], can[sa]
    # The first ``step`` symbols of a sorted suffix: its head, and heads further on.
    if width < step:
        blocks = [_from(head, at)[sa] for at in [*range(0, step - width, width), step - width]]
    else:
        blocks = [head[sa] >> (bits * (width - step))]
    rows = np.flatnonzero(can)
    interval = np.zeros(len(rows), np.int32)  # the empty string's interval: all suffixes
    depth, image = 0, np.full(n, -1, np.int32)
    while depth < length and len(rows):
        there = lf[rows]
        image[there] = interval
        target = np.flatnonzero(image >= 0) if 4 * len(rows) > n else np.sort(there)
        before = image[target]
        image[target] = -1
        new = np.ones(len(target), bool)
        new[1:] = before[1:] != before[:-1]
        for block in blocks:
            own = block[target]
            new[1:] |= own[1:] != own[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(target)))
        alive = size > 1
        rows = target[np.repeat(alive, size)]
        interval = np.repeat(np.arange(int(alive.sum()), dtype=np.int32), size[alive])
        depth += step
        if depth < length:
            on = can[rows]
            rows, interval = rows[on], interval[on]
    return sa[rows], interval


def keep_marks(texts: list[bytes], strings: np.ndarray, row_key: np.ndarray, start: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each different segment, which of its strings also start earlier in another."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(size) - size
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    text[first + size - 1] = 0
    step = next(s for s in range(min(STEP, length), 0, -1) if length % s == 0)
    position, interval = repeated(text, length, step)
    removed = np.zeros(len(text), bool)
    if len(position):
        owner = np.searchsorted(first, position, side="right") - 1
        order = np.lexsort((start[owner] + position - first[owner], row_key[owner], interval))
        again = np.zeros(len(order), bool)
        again[1:] = interval[order[1:]] == interval[order[:-1]]
        removed[position[order[again]]] = True
    return [removed[a : a + n] for a, n in zip(first.tolist(), strings.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


SEGMENTS = "anchor long, content long, row_key long, place long, info long"
FOUND = "anchor long, row_key long, start int, strings int, kind byte"
#: Kinds of found segments: repeats as a whole, those that meet others.
KNOWN, MEETS = 0, 1
LOW = (1 << 32) - 1


def frequent_anchors(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, least: int = FREQUENT, cut: tuple[list[int], ...] = ()) -> list[int]:
    """Anchors with many different segments in a sample of the rows; HEAVY at most.

    ``cut``: anchors of segments that are cut into parts; then those of parts are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            anchor, content, *_ = segments(*string_bytes(part.column("text")), length, frequent=cut, parts=True)
            yield _batch([anchor.view(np.int64), content.view(np.int64)], "anchor long, content long")

    rows = docs.where(F.pmod(F.xxhash64("row_key"), F.lit(sample)) == 0).select("text").mapInArrow(run, "anchor long, content long")
    many = rows.distinct().groupBy("anchor").count().where(F.col("count") >= least)
    return [r["anchor"] for r in many.orderBy(F.desc("count"), "anchor").limit(HEAVY).collect()]


def _segment_rows(docs: DataFrame, length: int, frequent: tuple[list[int], ...]) -> DataFrame:
    """The segments of all texts, equal ones of a slice counted together; place is start << 32 | strings.

    Info is the number of equal ones << 32 | sides. The earliest of these goes to its anchor. The others
    are repeats in any case: those that follow each other make one row (info 0), with a random number for
    an anchor, so that a frequent segment gets a row from each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            raw, off = string_bytes(part.column("text"))
            anchor, content, start, n, sides = segments(raw, off, length, frequent=frequent)
            if not len(anchor):
                continue
            doc = np.searchsorted(off, start, side="right") - 1
            key, start = part.column("row_key").to_numpy()[doc], start - off[doc]
            order = np.lexsort((start, key, content, anchor))
            a, c, s = anchor[order], content[order], sides[order] << 32 | n[order]
            lead = np.ones(len(order), bool)
            lead[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
            copies = np.diff(np.append(np.flatnonzero(lead), len(order)))
            ones = order[lead]
            info = copies << 32 | sides[ones]
            again = np.sort(order[~lead])  # by text and place
            joined = np.zeros(len(again), bool)
            joined[1:] = (key[again[1:]] == key[again[:-1]]) & (start[again[1:]] == start[again[:-1]] + n[again[:-1]]) & (again[1:] == again[:-1] + 1)
            head = np.flatnonzero(~joined)
            total = np.add.reduceat(n[again], head) if len(head) else head
            again = again[head]
            k, at = key[again], start[again]
            yield _batch(
                [np.concatenate([anchor[ones], _finish(k.astype(np.uint64) * BASE + at.astype(np.uint64))]).view(np.int64), np.concatenate([content[ones], np.zeros(len(k), np.uint64)]).view(np.int64),
                 np.concatenate([key[ones], k]), np.concatenate([start[ones] << 32 | n[ones], at << 32 | total]), np.concatenate([info, np.zeros(len(k), np.int64)])], SEGMENTS)

    return docs.select("row_key", "text").mapInArrow(run, SEGMENTS)


class Settling:
    """Segments as they come by anchor, content, row_key and place: which are repeats, which matter further.

    Of equal segments the first stays and the others are repeats. One that stays matters further if it
    shares a side with another of its anchor. Only the different segments of one anchor are held.
    """

    def __init__(self):
        self.open = {c: np.zeros(0, np.int64) for c in ("anchor", "content", "row_key", "place", "info")}

    def put(self, batch: pa.RecordBatch | None) -> pa.RecordBatch:
        x = self.open if batch is None else {c: np.concatenate([v, batch.column(c).to_numpy()]) for c, v in self.open.items()}
        n = len(x["anchor"])
        whole = x["info"] == 0
        sides = x["info"] & LOW
        new = np.ones(n, bool)
        if n:
            new[1:] = (x["anchor"][1:] != x["anchor"][:-1]) | (x["content"][1:] != x["content"][:-1]) | (sides[1:] != sides[:-1]) | ((x["place"][1:] ^ x["place"][:-1]) & LOW != 0)
            new |= whole
            new[1:] |= whole[:-1]
        known = ~new | whole
        turn = np.ones(n, bool)
        turn[1:] = x["anchor"][1:] != x["anchor"][:-1]
        stay = np.flatnonzero(~known)
        done = len(stay) if batch is None else int(np.searchsorted(x["anchor"][stay] == x["anchor"][-1], True)) if n else 0
        self.open = {c: v[stay[done:]] for c, v in x.items()}
        one, group = stay[:done], np.cumsum(turn)[stay[:done]]
        meets = np.zeros(done, bool)
        for side in (sides[one] >> 16, sides[one] & 0xFFFF):
            _, at, many = np.unique(group << 16 | side, return_inverse=True, return_counts=True)
            meets |= (many[at] > 1) & (side > 0)
        kind = np.full(n, KNOWN, np.int8)
        kind[one] = MEETS
        out = np.concatenate([np.flatnonzero(known), one[meets]])
        return _batch([x["anchor"][out], x["row_key"][out], (x["place"][out] >> 32).astype(np.int32), (x["place"][out] & LOW).astype(np.int32), kind[out]], FOUND)


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """Repeats, and the different segments that may have a string in common with others (see ``Settling``)."""
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "content", "row_key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settling = Settling()
        for batch in batches:
            if batch.num_rows:
                yield settling.put(batch)
        yield settling.put(None)

    return dealt.mapInArrow(run, FOUND)


WITH_BYTES = "anchor long, row_key long, start int, strings int, bytes binary"


def _with_texts(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The different segments with their bytes."""
    wanted = found.where(F.col("kind") != KNOWN).groupBy("row_key").agg(F.collect_list(F.struct("start", "strings", "anchor")).alias("segments"))
    joined = texts.join(wanted, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 2 << 20):
            raw, off = string_bytes(part.column("text"))
            lists = part.column("segments")
            inner = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(part.num_rows), counts)
            start, n, anchor = (inner.field(i).to_numpy() for i in range(3))
            a, text = off[doc] + start, raw.tobytes()
            bytes_ = [text[i:j] for i, j in zip(a.tolist(), (a + n + length - 1).tolist(), strict=True)]
            yield _batch([anchor, part.column("row_key").to_numpy()[doc], start, n, pa.array(bytes_, pa.binary())], WITH_BYTES)

    return joined.select("row_key", "text", "segments").mapInArrow(run, WITH_BYTES)


MARKS = "row_key long, start int, strings int"


def _expanded(rows: DataFrame, length: int) -> DataFrame:
    """Repeats among the different segments of each anchor: (row_key, start, strings)."""
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")

    def index(batch: pa.Table) -> pa.RecordBatch:
        key, start, n = (batch.column(c).to_numpy() for c in ("row_key", "start", "strings"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, flags in enumerate(keep_marks(batch.column("bytes").to_pylist(), n, key, start, length)):
            if flags.any():
                a, b = _runs(flags)
                out.append((np.full(len(a), key[i]), start[i] + a, b - a))
        k, s, m = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return _batch([k, s.astype(np.int32), m.astype(np.int32)], MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("suffix", dict)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in text_slices(iter([batch]), "bytes", INDEX_BYTES // 4):
                held.append(part)
                size += part.column("bytes").nbytes
                last = part.column("anchor")[-1].as_py()
                if size < INDEX_BYTES or last == held[0].column("anchor")[0].as_py():
                    continue
                # The last anchor goes on: its segments stay, from whichever part on they came.
                whole = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.searchsorted(whole.column("anchor").to_numpy(), last))
                yield index(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                size = sum(x.column("bytes").nbytes for x in held)
        if held:
            yield index(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, MARKS)


def repeats(docs: DataFrame, length: int = LENGTH, sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` (with row_key, text and whatever else) and ``runs``: the maximal removed byte ranges.

    runs is an array of struct<start int, end int>, ascending, null where nothing is removed. A
    byte is removed if a ``length``-byte string over it starts earlier too: in a row of smaller
    row_key, or before in the same row. Strings are judged on the input and never cross rows.
    ``sample`` and ``frequent`` say which anchors' segments are cut (see ``frequent_anchors``).
    """
    small_batches(docs.sparkSession)
    anchors = frequent_anchors(docs, length, sample, frequent)
    cut = (anchors, frequent_anchors(docs, length, sample, max(2, -(-BLOCK // sample)), (anchors,))) if anchors else ()
    found = materialize(_shared_anchors(_segment_rows(docs, length, cut)), "segments")
    marks = _expanded(_with_texts(docs.select("row_key", "text"), found, length), length)
    known = found.where(F.col("kind") == KNOWN).select("row_key", "start", "strings").union(marks)
    runs = known.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("strings") + F.lit(length - 1)).alias("end")))).alias("runs"))
    return docs.join(materialize(runs, "runs"), "row_key", "left")


def _union(lists: pa.ListArray) -> list[list[tuple[int, int]]]:
    out = []
    for runs in lists.to_pylist():
        merged: list[list[int]] = []
        for r in runs or []:
            if merged and r["start"] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], r["end"])
            else:
                merged.append([r["start"], r["end"]])
        out.append(merged)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_key, doc_id, kept binary, n_bytes, n_removed, n_spans long) of every row of docs (doc_id, text).

    A null text is empty. Rows with equal or null doc_ids stay, and count as earlier or later by
    ``common.keyed`` (nulls first, then by text). ``kept`` are the remaining bytes concatenated, which may
    cut a character in two. No rows give no rows; further columns are ignored.
    """
    rows = repeats(keyed(docs, []), length).select("row_key", "doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            raw, off = string_bytes(part.column("text"))
            left, removed, spans = [], [], []
            for i, runs in enumerate(_union(part.column("runs"))):
                text = raw[off[i] : off[i + 1]].tobytes()
                at, pieces = 0, []
                for a, b in runs:
                    pieces.append(text[at:a])
                    at = b
                left.append(b"".join([*pieces, text[at:]]))
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
            yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("doc_id"), pa.array(left, pa.binary()), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["row_key", "doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(run, "row_key long, doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def remove_repeated_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, all other columns as they are.

    Where a cut leaves a part of a character, that part goes too. A null text stays null.
    """
    rows = repeats(keyed(docs, key="_row_key").withColumnRenamed("_row_key", "row_key"), length) if "row_key" not in docs.columns else repeats(docs, length)
    names = docs.schema.names
    rows = rows.select(*names, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            texts = []
            for text, cuts in zip(part.column("text").to_pylist(), _union(part.column("runs")), strict=True):
                if cuts:
                    raw, at, pieces = text.encode(), 0, []
                    for a, b in cuts:
                        pieces.append(raw[at:a].decode("utf-8", "ignore"))
                        at = b
                    text = "".join([*pieces, raw[at:].decode("utf-8", "ignore")])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else c for n, c in zip(names, part.columns[:-1], strict=True)], names)

    return rows.mapInArrow(run, rows.drop("runs").schema)
