"""N-best segmentation over a SentencePiece vocabulary, and decoding.

The pieces that match a string are the edges of a lattice. A piece's score is a log-probability. The model
file of a byte-pair vocabulary has none, but minus the rank of each piece; the sum of ranks would favour many frequent
short pieces. So ranks become probabilities by Zipf's law with Mandelbrot's offset, p(r) ~ 1 / (r + 2.7), a fixed
transform under which every further piece costs. A model of log-probabilities is taken as it is. A forward
Viterbi pass gives each place's best score from the start; a search from the end backwards then
takes those scores as its heuristic. It is exact, so A* completes paths in order of their scores
and stops at the n-th.

A text's lattice falls apart between any two characters that no piece has next to each other (so a long text
without white space is many parts too), and
its n-best list combines those of the parts: in any of the n best, at most n - 1 parts are not at
their best, and they are among the n - 1 with the smallest losses. A part's smallest loss is that
of the best path over an edge off its best path, from the Viterbi scores of both directions; only
parts with the smallest losses of a text are searched.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, ragged, small_batches, string_bytes, text_slices
from .tokens import CACHE_BYTES, ChunkTable

MARK = "▁"
#: Stands for a text's own U+2581, which is no space: it has no piece, so it becomes bytes.
OWN_MARK = "\udc00"
OFFSET = 2.7  # of Zipf's law


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """The pieces' scores if they are log-probabilities, else those of their ranks."""
    values = np.array(list(scores.values()))
    if len(values) < 2 or not ((values == np.round(values)).all() and values.min() < -100):
        return scores
    likely = 1 / (OFFSET - values)
    return dict(zip(scores, np.log(likely / likely.sum()).tolist(), strict=True))


def characters(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters that begin at these places."""
    padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[at + i] for i in range(4))
    two, three = (a & 31) << 6 | (b & 63), (a & 15) << 12 | (b & 63) << 6 | (c & 63)
    return np.where(a < 0x80, a, np.where(a < 0xE0, two, np.where(a < 0xF0, three, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | (d & 63))))


class Lattice:
    """A vocabulary's pieces with their scores; characters without a piece become bytes."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: list[bytes] = []
        self.score: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.byte: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.pieces.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.pieces.append(b"")
            else:
                self.score[name] = (sp.get_score(i), (i,))
                self.pieces.append(name.replace(MARK, " ").encode())
        self.unknown = sp.unk_id()
        fitted = log_probabilities({name: score for name, (score, _) in self.score.items()})
        self.score = {name: (fitted[name], ids) for name, (_, ids) in self.score.items()}
        #: Pieces with score and ids; what only begins a piece has neither.
        self.found: dict[str, tuple] = {name[:i]: () for name in self.score for i in range(1, len(name))} | self.score
        self.penalty = min(s for s, _ in self.score.values()) - 10.0
        #: By two bytes of ASCII: no piece has them next to each other.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for name in self.score:
            raw = name.replace(MARK, " ").encode()
            self.apart[list(raw[:-1]), list(raw[1:])] = False
        #: Two characters, not both of ASCII, that a piece has next to each other, as one number.
        self.joined = np.array(sorted({ord(a) << 21 | ord(b) for name in self.score for a, b in itertools.pairwise(name.replace(MARK, " ")) if a > "\x7f" or b > "\x7f"} | {0}), np.int64)

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Which places of a text no piece is on both sides of (by the byte after; not the first)."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = self.apart[raw[:-1], raw[1:]]
        high = raw >= 0x80
        if high.any():
            begins = (raw & 0xC0) != 0x80
            at = np.flatnonzero(begins)  # characters; a pair is taken where one of its two isn't of ASCII
            some = np.flatnonzero(high[at[1:]] | high[at[:-1]])
            pair = characters(raw, at[some]) << 21 | characters(raw, at[some + 1])
            place = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
            cut[at[some + 1]] = self.joined[place] != pair
        return cut

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """By end: (start, score, ids) of each edge."""
        n, get, out = len(text), self.found.get, [[] for _ in range(len(text) + 1)]
        for a in range(n):
            b = a + 1
            found = get(text[a])
            if not found:
                ids = tuple(self.byte.get(x, self.unknown) for x in (MARK if text[a] == OWN_MARK else text[a].replace(MARK, " ")).encode())
                out[b].append((a, self.penalty * len(ids), ids))
            while found is not None:
                if found:
                    out[b].append((a, *found))
                b += 1
                if b > n:
                    break
                found = get(text[a:b])
        return out

    def best(self, text: str) -> tuple[float, float, tuple[int, ...]]:
        """Score of the best segmentation, loss of the next one (infinite if there is none), ids of the best."""
        edges = self.edges(text)
        ahead, back = [0.0], [None]
        for found in edges[1:]:
            edge = found[0]
            score = ahead[edge[0]] + edge[1]
            for e in found:
                if (through := ahead[e[0]] + e[1]) > score:
                    score, edge = through, e
            ahead.append(score)
            back.append(edge)
        best, b = [], len(text)
        while b:
            best.append(back[b])
            b = back[b][0]
        ids = tuple(i for e in reversed(best) for i in e[2])
        on = {id(e) for e in best}
        behind, total, other = [-np.inf] * len(text) + [0.0], ahead[-1], -np.inf
        for b in range(len(text), 0, -1):
            rest = behind[b]
            for e in edges[b]:
                a, through = e[0], e[1] + rest
                if through > behind[a]:
                    behind[a] = through
                if ahead[a] + through > other and id(e) not in on:
                    other = ahead[a] + through
        return total, total - other, ids

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first; equal scores come in a fixed order."""
        if not text:
            return [(0.0, ())]
        edges = self.edges(text)
        best = [0.0]
        for found in edges[1:]:
            best.append(max([best[a] + s for a, s, _ in found]))
        ranked: list[list | None] = [None] * len(edges)

        def at(b: int) -> list[tuple[float, int, float, tuple[int, ...]]]:
            """The edges into b by their best complete score, best first."""
            if ranked[b] is None:
                ranked[b] = sorted([(-(best[a] + s), len(own), a, s, own) for a, s, own in edges[b]])
            return ranked[b]

        # An entry is one edge to try behind a path to the end; taking it off puts its next sibling
        # and the best edge ahead of it on: (-(score behind + best through the edge), order, ...).
        order = itertools.count(1).__next__
        end = len(text)
        heap = [(at(end)[0][0], 0, end, 0, 0.0, None)]
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap:
            _, _, b, i, behind, path = heapq.heappop(heap)
            siblings = at(b)
            if i + 1 < len(siblings):
                heapq.heappush(heap, (siblings[i + 1][0] - behind, order(), b, i + 1, behind, path))
            _, _, a, s, own = siblings[i]
            behind, path = behind + s, (own, path)
            if a:
                heapq.heappush(heap, (at(a)[0][0] - behind, order(), a, 0, behind, path))
                continue
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((behind, tuple(ids)))
            if len(out) == n:
                break
        return out


def marked(text: bytes) -> str:
    """A text as the lattice takes it: spaces as marks, and the text's own marks apart from these."""
    return text.decode().replace(MARK, OWN_MARK).replace(" ", MARK)


@lru_cache(4)
def lattice(model: str) -> Lattice:
    return Lattice(model)


class Segmenter:
    """N-best lists of whole texts; a worker searches each different part once."""

    def __init__(self, model: str, n: int = 4, most: int = 1_000_000):
        self.lattice, self.n, self.most = lattice(model), n, most
        self.table = ChunkTable()
        self._clear()

    @classmethod
    def shared(cls, model: str, n: int) -> Segmenter:
        """A worker's own segmenter of this vocabulary."""
        return kept(("segmenter", model, n), lambda: cls(model, n))

    def _clear(self) -> None:
        self.table.clear()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.end = np.zeros(1 << 14, np.int64)  # where part i's best ids end in the pool, at i + 1
        self.score, self.loss = np.zeros(1 << 14), np.zeros(1 << 14)
        self.lists: dict[int, list[tuple[float, np.ndarray]]] = {}

    def _learn(self, new: list[bytes], base: int) -> None:
        found = [self.lattice.best(marked(x)) for x in new]
        ends = np.cumsum([len(ids) for _, _, ids in found]) + self.end[base]
        while base + len(new) + 1 > len(self.end):
            self.end, self.score, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.end, self.score, self.loss))
        while ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.end[base + 1 : base + 1 + len(new)] = ends
        self.pool[self.end[base] : ends[-1]] = np.fromiter((i for _, _, ids in found for i in ids), np.uint32, int(ends[-1] - self.end[base]))
        self.score[base : base + len(new)] = [x for x, _, _ in found]
        self.loss[base : base + len(new)] = [x for _, x, _ in found]

    def _others(self, part: int, text: bytes) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of a part's best segmentations besides the first, n - 1 at most."""
        if part not in self.lists:
            own = tuple(self.pool[self.end[part] : self.end[part + 1]].tolist())
            found = [(float(self.score[part]) - s, np.array(ids, np.uint32)) for s, ids in self.lattice.nbest(marked(text), self.n) if ids != own]
            self.lists[part] = found[: self.n - 1]
        return self.lists[part]

    def encode(self, column: pa.Array) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its n best (score, ids); a null or empty text has the empty one alone."""
        if self.table.n > self.most or self.table.long_bytes + self.pool.nbytes > CACHE_BYTES:
            self._clear()
        n = self.n
        raw, off = string_bytes(pa.array([f" {t}" if t else "" for t in column.to_pylist()], pa.string()))
        cut = self.lattice.cuts(raw)
        cut[off] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        base = self.table.n
        which, new = self.table.numbers(raw, starts, ends)
        if new:
            self._learn(new, base)
        first = self.end[which]
        size = self.end[which + 1] - first
        ids = self.pool[ragged(first, size)]
        place = np.concatenate([[0], np.cumsum(size)])
        score, loss = self.score[which], self.loss[which]
        bounds = np.searchsorted(starts, off)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out = [(float(score[a:b].sum()), ids[place[a] : place[b]])]
            if n > 1 and b > a:
                near = a + np.argsort(loss[a:b], kind="stable")[: n - 1]
                choices = [[(0.0, None), *self._others(int(which[i]), raw[starts[i] : ends[i]].tobytes())] for i in near.tolist()]
                ranked = sorted((sum(c[r][0] for c, r in zip(choices, pick, strict=True)), pick) for pick in itertools.product(*(range(len(c)) for c in choices)))[1:n]
                for less, pick in ranked:
                    parts, at = [], place[a]
                    for i, other in sorted((i, c[r][1]) for i, c, r in zip(near.tolist(), choices, pick, strict=True) if r):
                        parts += [ids[at : place[i]], other]
                        at = place[i + 1]
                    out.append((out[0][0] - less, np.concatenate([*parts, ids[at : place[b]]])))
            yield out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the space before the text."""
        return b"".join(map(self.lattice.pieces.__getitem__, ids.tolist())).removeprefix(b" ")


def encode_nbest(docs: DataFrame, model: str, n: int = 4, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """(key, nbest array<struct<score double, ids array<int>>>, round_trip boolean) of every row of docs (key, text).

    round_trip: the best list decodes to the text's bytes (also where these have the mark for spaces,
    U+2581, in them). With ``digest``, per row instead:
    n_pieces long, score double, ids_crc32 long (little-endian unsigned 32-bit ids) of the best list, nbest_scores and
    nbest_crc32 arrays of all, round_trip. A null or empty text has one empty list; equal and
    null keys stay as rows; further columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.shared(model, n)
        for part in text_slices(batches, "text", 2 << 20):
            found = list(segmenter.encode(part.column("text")))
            texts = part.column("text").to_pylist()
            same = pa.array([segmenter.decode(f[0][1]) == (t or "").encode() for f, t in zip(found, texts, strict=True)])
            if digest:
                crc = [[zlib.crc32(ids.astype("<u4")) for _, ids in f] for f in found]
                columns = [pa.array([len(f[0][1]) for f in found], pa.int64()), pa.array([f[0][0] for f in found]), pa.array([c[0] for c in crc], pa.int64()), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())), pa.array(crc, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns, same], [key, "n_pieces", "score", "ids_crc32", "nbest_scores", "nbest_crc32", "round_trip"])
            else:
                lists = pa.array([[{"score": s, "ids": ids.astype(np.int32)} for s, ids in f] for f in found], pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))])))
                yield pa.RecordBatch.from_arrays([part.column(key), lists, same], [key, "nbest", "round_trip"])

    what = "n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>" if digest else "nbest array<struct<score double, ids array<int>>>".replace("score double, ids array", "score: double, ids: array")
    return docs.selectExpr(f"cast({key} as long) {key}", "cast(text as string) text").mapInArrow(run, f"{key} long, {what}, round_trip boolean")
