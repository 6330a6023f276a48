"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of radius + 1 bits; each non-zero vector of that length
makes a table, whose mask keeps the bits with an odd product. Up to ``radius`` differing bits
have vectors that some table's vector is orthogonal to, all of them, so its mask hides just these
bits and the pair shares that table's key: no pair within the radius is lost (covering LSH
without false negatives). A mask keeps about 34 bits.

Texts with a Jaccard similarity of 0.8 differ in about ten bits of 64, out of reach of such masks.
``similar_groups`` therefore also covers fingerprints of 16 four-bit minima (MinHash), which differ
in about three at 0.8. Every bucket of either names each of its texts two partners, those whose minima agree
most; a text keeps the best of its partners and tries them, two a round, by the exact similarity of the
shingles, as long as they are in other groups than its own. So no bucket's pairs are all sent out, however
many copies it holds. What the rounds leave in different groups is then compared whole: buckets go out as blocks of
sets, each set once a block, so no link between candidates is lost to the choice of partners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, keyed, materialize, ragged, small_batches, text_slices
from .components import connected_components

SEGMENT = 255  # shingles whose bits add up in bytes
SKETCHES = 3  # fingerprints of minima
NEAR_MINIMA = 7  # of 16, that may differ in a candidate
LIKE_MINIMA = 26  # of all 48, that agree in a candidate: at a similarity of 0.8 39 do, and 26 or fewer once in a million
PARTNERS, ROUNDS = 2, 4  # that a text tries in a round, and rounds
BLOCK = 512  # rows of a bucket among which rounds look for partners; larger buckets are ordered by other minima and cut
CELL_ROWS, CELL_SHINGLES = 1024, 1 << 20  # of a side of a cell of the last pass; one longer text is a side by itself
_PRINTS = ["fp", *[f"s{i}" for i in range(SKETCHES)]]
_MIX = np.random.default_rng(42).integers(0, 2**64, (2, 16 * SKETCHES), np.uint64)


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of a text's shingles: ``width`` words joined by spaces, A-Z in lower case."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(line, 42)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return [hashed(line[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """A 64-bit fingerprint per text; one without words has fingerprint 0."""
    return _fingerprints([shingle_hashes(t, width) for t in texts])


def _fingerprints(hashes: list[list[int]]) -> np.ndarray:
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
    n = n[full]
    parts = -(-n // SEGMENT)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(n) - n, parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(first, parts))
    sums = np.zeros((len(starts), 64), np.uint8)
    for a in range(0, len(starts), 1024):
        low, high = starts[a], starts[a + 1024] if a + 1024 < len(starts) else len(flat)
        bits = np.unpackbits(flat[low:high].astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums[a : a + 1024] = np.add.reduceat(bits, starts[a : a + 1024] - low, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    out[full] = np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1).view(">u8").ravel()
    return out


def shingle_sets(hashes: list[list[int]]) -> list[np.ndarray]:
    """The different shingles of each text, ascending."""
    return [np.unique(np.array(h, np.uint64)) for h in hashes]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCHES fingerprints (columns) per set, each of four bits of its minima under 16 hashes."""
    n = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), SKETCHES), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        flat, starts = np.concatenate(sets), np.cumsum(n[full]) - n[full]
        for i in range(16 * SKETCHES):
            least = np.minimum.reduceat((flat ^ _MIX[0, i]) * (_MIX[1, i] | np.uint64(1)), starts)
            out[full, i // 16] |= (least >> np.uint64(20) & np.uint64(15)) << np.uint64(4 * (i % 16))
    return out


def fingerprint_table(docs: DataFrame, width: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fp) for every row of docs; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash", dict)
        for part in text_slices(batches, "text"):
            fp = fingerprints(part.column("text").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fp)], [key, "fp"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} long, fp long")


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks; bit i's vector is i mod that number, plus 1."""
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % tables + 1) & v).bit_count() & 1) for v in range(1, tables + 1)]


def sketch_masks() -> list[int]:
    """31 masks over 16 minima of four bits, of which up to four may differ; minimum i's vector is 16 + i.

    The kept minima are the words of the first-order Reed-Muller code: eight of 16, or all.
    """
    return [sum(15 << 4 * i for i in range(16) if ((16 + i) & v).bit_count() & 1) for v in range(1, 32)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as bitwise_count counts those of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def minima_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing groups of four bits."""
    x = (a ^ b).view(np.uint64)
    x = x | x >> np.uint64(2)
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1111111111111111))


def _spanning(group: np.ndarray, fps: np.ndarray, radius: int, differ: Callable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of one bucket's rows (indices to fps), breadth first, a block at a time."""
    left, out = group, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            parent = np.zeros(len(left), left.dtype)
            for a in range(0, len(front), 256):
                for b in range(0, len(left), 65536):
                    apart = differ(fps[front[a : a + 256], None], fps[None, left[b : b + 65536]])
                    hit = (apart <= radius).any(0)
                    parent[b : b + 65536][hit] = front[a : a + 256][apart[:, hit].argmin(0)]
                    reached[b : b + 65536] |= hit
            if reached.any():
                out.append((left[reached], parent[reached]))
            front, left = left[reached], left[~reached]
    return out


def bucket_edges(keys: np.ndarray, fps: np.ndarray, radius: int = 3, small: int = 64, ids: np.ndarray | None = None, differ: Callable = distance) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: every pair of a small run, a spanning forest of a larger one.

    ``ids`` names the rows in the links, else their fingerprints do.
    """
    ids = fps if ids is None else ids
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(keys)))
    out = []
    few = (size > 1) & (size <= small)
    at = ragged(starts[few], size[few])
    run = np.repeat(np.arange(int(few.sum())), size[few])
    for d in range(1, int(size[few].max(initial=1))):
        a, b = at[:-d], at[d:]
        same = run[:-d] == run[d:]
        a, b = a[same], b[same]
        near = differ(fps[a], fps[b]) <= radius
        out.append((a[near], b[near]))
    for i in np.flatnonzero(size > small):
        out += _spanning(np.arange(starts[i], starts[i] + size[i]), fps, radius, differ)
    if not out:
        return ids[:0], ids[:0]
    return ids[np.concatenate([x for x, _ in out])], ids[np.concatenate([x for _, x in out])]


def in_buckets(rows: DataFrame, tables: Sequence[tuple[str, int]], columns: Sequence[str], work: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """Deal ``rows`` to the buckets of all tables (column, mask) and do ``work`` on whole buckets.

    Work gets the table of each row, its bucket's number, ascending, and the columns as rows of one array; a
    column "print" is the fingerprint that the table covers. It returns columns of longs.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    parts = F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).bitwiseAND(F.lit(_signed(m))).alias("key"), *([F.col(c).alias("print")] if "print" in columns else [])) for i, (c, m) in enumerate(tables)])
    dealt = rows.select(F.explode(parts).alias("b"), *[c for c in columns if c != "print"]).select("b.t", "b.key", *["b.print" if c == "print" else c for c in columns]).repartition("t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in work(rows[0], np.cumsum(new), rows[2:])], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            first, last = held[0][:2, 0], held[-1][:2, -1]
            if (first == last).all():
                continue  # one bucket so far
            rows = np.concatenate(held, axis=1)
            end = int(np.flatnonzero((rows[:2] != last[:, None]).any(0))[-1]) + 1
            yield done(rows[:, :end])
            held = [rows[:, end:]]
        if held:
            yield done(np.concatenate(held, axis=1))

    return dealt.mapInArrow(run, schema)


def link(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) that connect the fingerprints (fp) within the radius of each other."""

    def work(_: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        return list(bucket_edges(bucket, rows[0], radius))

    return in_buckets(distinct, [("fp", m) for m in covering_masks(radius)], ["print"], work, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every row of docs (key, text).

    Fingerprints within ``radius`` bits are linked; component_id is the smallest key that links
    lead to. Rows with equal fingerprints share all of this and are linked through one of them. A
    null or empty text has fingerprint 0, linked like any other. Equal keys stay as rows; a null
    key stays null and counts as no key, so a component of nulls only has a null id. No rows
    give no rows; further columns are ignored.
    """
    prints = materialize(fingerprint_table(docs, width, key), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
    parts = connected_components(link(reps.select("fp"), radius)).select(F.col("vertex").alias("fp"), F.col("component").alias("root"))
    marked = reps.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    ids = marked.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = materialize(marked.join(ids, "root").select("fp", "component_id"), "groups")
    return prints.join(found, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_table(docs: DataFrame, width: int, key: str) -> DataFrame:
    """(key, set, fp, s0, s1 .., size) of every row: a digest of its different shingles, SimHash, sketches, their number."""
    small_batches(docs.sparkSession)
    names = [*_PRINTS[1:], "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash", dict)
        for part in text_slices(batches, "text"):
            hashes = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
            sets = shingle_sets(hashes)
            digest = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64)
            columns = [digest, _fingerprints(hashes), *sketches(sets).T, np.array([len(x) for x in sets], np.int64)]
            yield pa.RecordBatch.from_arrays([part.column(key), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]], [key, "set", "fp", *names])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} long, set long, fp long, " + ", ".join(f"{c} long" for c in names))


@lru_cache(8)
def _tables(radius: int) -> tuple[tuple[str, int], ...]:
    return (*(("fp", m) for m in covering_masks(radius)), *((f"s{i}", m) for i in range(SKETCHES) for m in sketch_masks()))


def _column(table: int | np.ndarray, radius: int) -> int | np.ndarray:
    """The row (fp, s0 ..) whose fingerprint a table covers."""
    own, many = 2 ** (radius + 1) - 1, 31
    return (table >= own) * (1 + (table - own) // many)


def _near(kind: int | np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints of this kind (0: SimHash, else minima) are those of candidates."""
    if np.ndim(kind):
        return np.where(kind == 0, distance(a, b) <= radius, minima_distance(a, b) <= NEAR_MINIMA)
    return minima_distance(a, b) <= NEAR_MINIMA if kind else distance(a, b) <= radius


def _blocks(table: int, rows: np.ndarray, most: int = BLOCK) -> list[np.ndarray]:
    """Positions of one bucket's rows (fp, s0 ..), cut into blocks of ``most`` at most, in another order for each table."""
    n = rows.shape[1]
    if n <= most:
        return [np.arange(n)]
    turned = np.roll(rows, table, axis=0).view(np.uint64)
    return np.array_split(np.lexsort([np.bitwise_right_shift(x, np.uint64(4 * (table % 16))) | np.bitwise_left_shift(x, np.uint64(64 - 4 * (table % 16)) % np.uint64(64)) for x in turned]), -(-n // most))


def small_pairs(kind: np.ndarray, bucket: np.ndarray, prints: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions i < j of the candidates in buckets of up to ``small`` rows, and the larger buckets' bounds."""
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    start, size = edge[:-1], np.diff(edge)
    few = (size > 1) & (size <= small)
    at = ragged(start[few], size[few])
    values, run, kinds = prints[at], bucket[at], kind[at]
    first, second = [at[:0]], [at[:0]]
    for d in range(1, int(size[few].max(initial=1))):
        same = np.flatnonzero(run[:-d] == run[d:])
        same = same[_near(kinds[same], values[same], values[same + d], radius)]
        first.append(at[same])
        second.append(at[same + d])
    large = size > small
    return np.concatenate(first), np.concatenate(second), list(zip(start[large].tolist(), (start + size)[large].tolist(), strict=True))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima of rows (fp, s0 ..) agree."""
    return 16 * SKETCHES - sum(minima_distance(a[1 + i], b[1 + i]).astype(np.int16) for i in range(SKETCHES))


def best_partners(table: int, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row (fp, s0 ..) of one large bucket its best candidates: two positions, minima."""
    out, kind = [], int(_column(table, radius))
    for block in _blocks(table, rows):
        inner = rows[:, block]
        i, j = np.nonzero(_near(kind, inner[kind, :, None], inner[kind, None, :], radius) & ~np.eye(len(block), dtype=bool))
        out.append([block[i], block[j], agreeing(inner[:, i], inner[:, j]).astype(np.int64)])
        out[-1] = first_of(*out[-1])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def first_of(i: np.ndarray, j: np.ndarray, like: np.ndarray) -> list[np.ndarray]:
    """Of the pairs of each i the PARTNERS that agree most (of equal ones, those of the smallest j), if they are candidates."""
    order = np.lexsort((j, -like, i))
    order = order[like[order] >= LIKE_MINIMA]
    i, j, like = i[order], j[order], like[order]
    lead = np.arange(len(i)) - np.searchsorted(i, i) < PARTNERS
    return [i[lead], j[lead], like[lead]]


def candidates(reps: DataFrame, radius: int) -> DataFrame:
    """The sets of ``reps`` (set, fp, s0 ..) that share a bucket with a candidate, or a bucket of over BLOCK sets."""

    def work(table: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        some, kind = np.zeros(len(bucket), bool), _column(table, radius)
        i, j, large = small_pairs(kind, bucket, rows[1], radius)
        some[i] = some[j] = True
        for a, b in large:
            inner = rows[1, a:b]
            some[a:b] |= b - a > BLOCK or _near(int(kind[a]), inner[:, None], inner[None], radius).sum(1) > 1  # itself and another
        return [np.unique(rows[0][some])]

    return in_buckets(reps, _tables(radius), ["set", "print"], work, "set long").distinct()


def proposals(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v, like) for rows (set, fp, s0 ..): from each bucket, each set's best candidates in it."""

    def work(table: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        kind = _column(table, radius)
        i, j, large = small_pairs(kind, bucket, rows[1 + kind, np.arange(len(bucket))], radius)
        like = agreeing(rows[1:, i], rows[1:, j]).astype(np.int64)
        out = [first_of(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([like, like]))]
        for a, b in large:
            x, y, like = best_partners(int(table[a]), rows[1:, a:b], radius)
            out.append([a + x, a + y, like])
        u, v, like = (np.concatenate(x) for x in zip(*out, strict=True))
        return [rows[0, u], rows[0, v], like]

    return in_buckets(rows, _tables(radius), ["set", *_PRINTS], work, "u long, v long, like long")


def open_pairs(table: int, root: np.ndarray, size: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j, of ``left`` and ``right`` rows (fp, s0 ..), of candidates of different roots that ``table`` is the first to have.

    Sizes that rule the similarity out leave a pair out.
    """
    kind, first, second = int(_column(table, radius)), [left[:0]], [left[:0]]
    for a in range(0, len(left), 256):
        for b in range(0, len(right), 4096):
            x, y = left[a : a + 256], right[b : b + 4096]
            i, j = np.nonzero(_near(kind, rows[kind][x][:, None], rows[kind][y][None], radius) & (root[x, None] != root[None, y]) & (x[:, None] < y[None]))
            i, j = _asked(table, x[i], y[j], size, rows, radius, similarity)
            first.append(i)
            second.append(j)
    return np.concatenate(first), np.concatenate(second)


def _asked(table: int | np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, rows: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of rows those that agree enough in minima and sizes and meet in ``table`` first."""
    least, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    some = (least >= similarity * most - 1e-6) & (agreeing(rows[:, i], rows[:, j]) >= LIKE_MINIMA)
    i, j = i[some], j[some]
    once = first_table(rows[:, i], rows[:, j], radius) == (table[i] if np.ndim(table) else table)
    return i[once], j[once]


def first_table(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The first table that has both of two rows (fp, s0 ..) in a bucket, as candidates."""
    tables = _tables(radius)
    out = np.full(a.shape[1], len(tables))
    differ = a ^ b
    near = [_near(kind, a[kind], b[kind], radius) for kind in range(len(a))]
    for t in reversed(range(len(tables))):
        kind = int(_column(t, radius))
        out[near[kind] & ((differ[kind] & np.int64(_signed(tables[t][1]))) == 0)] = t
    return out


def cells(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(cell, t, side, set) of the sets of rows (set, root, size, fp, s0 ..) that are candidates of sets of other groups.

    A cell is a bucket of table t, or two blocks of a larger one (sides 1 and 2; 3 is both). Each pair of candidates
    of different groups meets in one cell. Only sets with such a pair are sent, once a cell and not once a pair.
    """

    def work(table: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        ids, root, size, prints = rows[0], rows[1], rows[2], rows[3:]
        kind = _column(table, radius)
        i, j, large = small_pairs(kind, bucket, prints[kind, np.arange(len(bucket))], radius)
        apart = root[i] != root[j]
        i, j = _asked(table, i[apart], j[apart], size, prints, radius, similarity)
        at = np.unique(np.concatenate([i, j]))
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        lead = starts[np.searchsorted(starts, at, side="right") - 1]
        out = [[_cell(ids[lead], table[at], 0), table[at], np.full(len(at), 3), ids[at]]]
        for a, b in large:
            part, t = np.arange(a, b), int(table[a])
            part = part[np.argsort(root[a:b], kind="stable")]
            ends = np.cumsum(size[part])
            blocks = [x for y in np.split(part, np.flatnonzero(np.diff(ends // CELL_SHINGLES)) + 1) for x in np.split(y, range(CELL_ROWS, len(y), CELL_ROWS))]
            for p, x in enumerate(blocks):
                for q, y in enumerate(blocks[p:], p):
                    if root[x[0]] == root[y[-1]]:
                        continue  # one group: rows are ordered by root
                    if p == q:
                        at = np.unique(np.concatenate(open_pairs(t, root, size, prints, np.sort(x), np.sort(x), radius, similarity)))
                        side = np.full(len(at), 3)
                    else:
                        both = [open_pairs(t, root, size, prints, k, m, radius, similarity) for k, m in ((x, y), (y, x))]
                        one, two = np.unique(np.concatenate([both[0][0], both[1][1]])), np.unique(np.concatenate([both[0][1], both[1][0]]))
                        at, side = np.concatenate([one, two]), np.repeat([1, 2], [len(one), len(two)])
                    out.append([_cell(np.full(len(at), ids[a]), np.full(len(at), t), p << 32 | q), np.full(len(at), t), side, ids[at]])
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return in_buckets(rows, _tables(radius), ["set", "root", "size", *_PRINTS], work, "cell long, t long, side long, set long")


def _cell(lead: np.ndarray, table: np.ndarray, blocks: int) -> np.ndarray:
    """A number for a bucket (any of its sets, table) and its blocks; equal numbers of two cells do no harm."""
    x = lead.view(np.uint64) ^ (table.astype(np.uint64) + np.uint64(1)) * _MIX[1, 0] ^ np.uint64(blocks) * (_MIX[1, 1] | np.uint64(1))
    x = (x ^ x >> np.uint64(31)) * (_MIX[1, 2] | np.uint64(1))
    return (x ^ x >> np.uint64(29)).view(np.int64)


def _links(t: np.ndarray, side: np.ndarray, ids: np.ndarray, root: np.ndarray, size: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """The links that join the groups of one cell, those that agree most first; pairs of joined groups are not compared."""
    out, joined = [], {}

    def top(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    for table in np.unique(t).tolist():
        left, right = (np.flatnonzero((t == table) & (side & k > 0)) for k in (1, 2))
        found = [open_pairs(table, root, size, prints, x, y, radius, similarity) for x, y in (((left, right),) if (side == 3).all() else ((left, right), (right, left)))]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-agreeing(prints[:, i], prints[:, j]), kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = top(int(root[a])), top(int(root[b]))
            if x != y and jaccard(sets[a], sets[b]) >= similarity:
                joined[max(x, y)] = min(x, y)
                out.append((int(ids[a]), int(ids[b])))
    return out


def remaining(rows: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (u, v) of this similarity that join the groups (root) of rows (set, root, size, fp, s0 ..): every pair of
    candidates in different groups is compared, in the cell where it meets, unless the cell's other links join them."""
    names = ["cell", "t", "side", "set", "root", "size", *_PRINTS]
    met = materialize(cells(rows, radius, similarity), "cells")
    full = met.join(rows.select(*names[3:]), "set").join(sets, "set").select(*names, "shingles").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            t, side, ids, root, size, *prints = (whole.column(c).to_numpy() for c in names[1:])
            shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column("shingles")]
            links = _links(t, side, ids, root, size, np.stack(prints), shingles, radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([u for u, _ in links], [v for _, v in links])], ["u", "v"])

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if held and held[0].column("cell")[0].as_py() != cell[a]:
                        yield done()
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return full.mapInArrow(run, "u long, v long")


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """(set, shingles binary) of docs (set, text): the different shingles' hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = shingle_sets([shingle_hashes(t, width) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("set"), pa.array([x.tobytes() for x in sets], pa.binary())], ["set", "shingles"])

    return docs.select("set", "text").mapInArrow(run, "set long, shingles binary")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The exact similarity of two ascending sets; none for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of sets (set, shingles) that have this Jaccard similarity or more."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            both = zip(part.column("a"), part.column("b"), strict=True)
            near = [jaccard(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= similarity for a, b in both]
            yield part.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    a, b = (sets.select(F.col("set").alias(k), F.col("shingles").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(confirm, "u long, v long")


def similar_groups(docs: DataFrame, width: int = 5, radius: int = 3, similarity: float = 0.8, key: str = "doc_id") -> DataFrame:
    """(key, component_id) of every row of docs (unique key, text): groups that links of this similarity make.

    Equal sets of shingles are linked, texts without words among them. Every other text keeps its PARTNERS x
    ROUNDS best candidates and tries them, PARTNERS a round, by their exact similarity; those of its own group
    fall out. Rounds end when one finds no link. They join nearly all groups with work in proportion to the
    texts; then every pair of candidates that is still in different groups is compared (``remaining``), so no
    bucket's size and no number of partners loses a link.
    """
    prints = materialize(set_table(docs, width, key), "fingerprints")
    reps = materialize(prints.groupBy("set").agg(F.min(key).alias("rep"), *[F.min(c).alias(c) for c in (*_PRINTS, "size")]), "distinct")
    asked = materialize(reps.join(candidates(reps, radius), "set"), "candidates")
    texts = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    sets = materialize(shingle_table(texts.join(asked.select("set", F.col("rep").alias(key)), key), width), "shingles")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("like")).alias("order"), "v"))), 1, PARTNERS * ROUNDS)
    ranked = proposals(asked, radius).groupBy("u").agg(best.alias("best"))
    left = materialize(ranked.select("u", F.posexplode("best.v").alias("turn", "v")), "partners")
    parts, edges = None, None

    def grouped(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        whole = found if edges is None else edges.union(found)
        return whole, materialize(connected_components(whole).select(F.col("vertex").alias("set"), F.col("component").alias("root")), "parts")

    for _ in range(ROUNDS):
        own = left.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "v"))), 1, PARTNERS).alias("best"))
        pairs = own.select("u", F.explode("best.v").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        found = materialize(similar(pairs, sets, similarity), "similar")
        if not found.limit(1).count():
            break
        edges, parts = grouped(found)
        u, v = (parts.select(F.col("set").alias(c), F.col("root").alias(f"root_{c}")) for c in "uv")
        tried = own.select("u", F.explode("best").alias("b")).select("u", F.col("b.turn").alias("turn"))
        apart = left.join(u, "u", "left").join(v, "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "turn")
        left = materialize(apart.join(tried, ["u", "turn"], "left_anti"), "partners")
    rooted = lambda rows: rows.withColumn("root", F.col("set")) if parts is None else rows.join(parts, "set", "left").withColumn("root", F.coalesce("root", "set"))
    found = materialize(remaining(materialize(rooted(asked), "rooted"), sets, radius, similarity), "similar")
    if found.limit(1).count():
        edges, parts = grouped(found)
    marked = rooted(reps).select("set", "rep", "root")
    ids = marked.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(materialize(marked.join(ids, "root").select("set", "component_id"), "groups"), "set").select(key, "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id.

    Of rows with equal ids, ``common.keyed`` says which comes first. Other columns stay. With
    ``similarity``, near duplicates are those of ``similar_groups``, else of ``near_duplicates``.
    """
    rows = keyed(docs, key="_row_key")
    groups = similar_groups(rows, width, radius, similarity, "_row_key") if similarity else near_duplicates(rows, width, radius, key="_row_key")
    gone = materialize(groups.where("_row_key <> component_id").select("_row_key"), "gone")
    return rows.join(gone, "_row_key", "left_anti").select(*docs.columns)
