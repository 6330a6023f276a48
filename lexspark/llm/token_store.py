"""Token files: Elias-Fano document boundaries over a concatenated id array.

A file holds consecutive documents in ascending id order:

    magic "LXTOK1\\0" + id width in bytes (1) | n_docs u64 | n_tokens u64 | low bits of ends u8,
    low bits of ids u8, 6 bytes 0 | smallest document id i64 | range of the ids u64 | number of
    documents without an id u64 (they come first) | Elias-Fano of the ends | Elias-Fano of the
    other documents' ids, less the smallest | ids

An Elias-Fano part stores n ascending values below u: the low l = floor(log2(u / n)) bits of each,
packed, then a bit vector with bit (value >> l) + i set for the i-th value, padded to 8 bytes,
about 2 + log2(u / n) bits a value. ``select`` finds the i-th set bit through the popcounts of
64-bit words, kept as one 32-bit sum per 512 bits, so no table of 64-bit offsets exists on disk or
in memory.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, text_slices
from .tokens import ChunkEncoder

FILE_TOKENS = 16 << 20  # after which a task begins another file
MAGIC = b"LXTOK1\0"
BLOCK = 8  # 64-bit words that share one sum


class EliasFano:
    """n ascending values below ``universe``; ``select(i)`` returns the i-th values."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe = n, universe
        self.bits = self.low_bits(n, universe)
        self.low, self.high = low, high
        ones = np.bitwise_count(high).astype(np.uint32)
        pad = -len(ones) % BLOCK
        per = np.concatenate([ones, np.zeros(pad, np.uint32)]).reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        self.before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def sizes(cls, n: int, universe: int) -> tuple[int, int]:
        """Bytes of the low and of the high part."""
        bits = cls.low_bits(n, universe)
        return -(-n * bits // 8), -(-(n + (universe >> bits) + 1) // 64) * 8 if n else 0

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits, (_, high_bytes) = cls.low_bits(n, universe), cls.sizes(n, universe)
        low = np.zeros(0, np.uint8)
        if bits and n:
            shift = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        flags = np.zeros(high_bytes * 8, np.uint8)
        flags[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, universe, low, np.packbits(flags, bitorder="little").view("<u8"))

    def bytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes()

    @classmethod
    def decode(cls, n: int, universe: int, data: memoryview | bytes) -> EliasFano:
        a, b = cls.sizes(n, universe)
        return cls(n, universe, np.frombuffer(data, np.uint8, a), np.frombuffer(data, "<u8", b // 8, a))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at these positions: block by its sum, word in the block, bit in the word, low bits."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.before, index, side="right") - 1
        left = index - self.before[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            ones = np.bitwise_count(self.high[np.minimum(word, len(self.high) - 1)]).astype(np.int64)
            more = (left >= ones) & (word < len(self.high) - 1)
            left, word = left - ones * more, word + more
        rest, at = self.high[word], np.zeros(len(index), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(rest & np.uint64((1 << width) - 1)).astype(np.int64)
            more = left >= ones
            left, at = left - ones * more, at + width * more
            rest = np.where(more, rest >> np.uint64(width), rest)
        high = word * 64 + at - index
        low = np.zeros(len(index), np.int64)
        if self.bits:
            first = index * self.bits
            for b in range(self.bits):
                low |= ((self.low[(first + b) >> 3] >> ((first + b) & 7)) & 1).astype(np.int64) << b
        return (high << self.bits) | low


def pieces_of(doc_ids: np.ndarray, lengths: np.ndarray, ids: list[np.ndarray], width: int, nulls: int = 0) -> Iterator[bytes]:
    """The parts of a token file of documents (``nulls`` without an id, then ids ascending) and their token ids in pieces."""
    doc_ids, total = np.asarray(doc_ids, np.int64), sum(map(len, ids))
    n, least = len(doc_ids), int(doc_ids[0]) if len(doc_ids) else 0
    ends = EliasFano.encode(np.cumsum(lengths), total + 1)
    universe = int(doc_ids[-1]) - least + 1 if n else 1
    keys = EliasFano.encode(doc_ids.view(np.uint64) - np.uint64(least & (2**64 - 1)), universe)
    yield MAGIC + bytes([width]) + np.array([n + nulls, total], "<u8").tobytes() + bytes([ends.bits, keys.bits]) + bytes(6)
    yield np.array([least], "<i8").tobytes() + np.array([universe, nulls], "<u8").tobytes()
    yield ends.bytes()
    yield keys.bytes()
    for piece in ids:
        yield piece.astype(f"<u{width}").tobytes()


class TokenFile:
    """A token file: ``bounds(i)`` and ``ids(i)`` need no decoded table of offsets.

    ``read(at, n)`` gives n bytes of it. Its boundaries are read at once, its ids when they are asked for.
    """

    def __init__(self, read: Callable[[int, int], bytes]):
        data = read(0, 56)
        if data[:7] != MAGIC:
            raise ValueError("not a token file")
        self.read, self.width = read, data[7]
        self.n, self.tokens = map(int, np.frombuffer(data, "<u8", 2, 8))
        self.least = int(np.frombuffer(data, "<i8", 1, 32)[0])
        universe, self.nulls = map(int, np.frombuffer(data, "<u8", 2, 40))
        n = self.n - self.nulls
        ends, keys = sum(EliasFano.sizes(self.n, self.tokens + 1)), sum(EliasFano.sizes(n, universe))
        self.ends = EliasFano.decode(self.n, self.tokens + 1, read(56, ends))
        self.keys = EliasFano.decode(n, universe, read(56 + ends, keys))
        self.first = 56 + ends + keys

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(lambda at, n: data[at : at + n])

    def span(self, a: int, b: int) -> np.ndarray:
        """The token ids from the a-th to before the b-th of the file."""
        return np.frombuffer(self.read(self.first + a * self.width, (b - a) * self.width), f"<u{self.width}")

    def bounds(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.asarray(index, np.int64)
        start = np.where(index > 0, self.ends.select(np.maximum(index - 1, 0)), 0)
        return start, self.ends.select(index)

    def doc_ids(self, index: np.ndarray) -> np.ma.MaskedArray:
        """Ids at these positions, masked where a document has none."""
        index = np.asarray(index, np.int64)
        out = np.ma.masked_all(len(index), np.int64)
        own = index >= self.nulls
        out[own] = self.keys.select(index[own] - self.nulls) + self.least
        return out

    def ids(self, i: int) -> np.ndarray:
        (a,), (b,) = self.bounds(np.array([i]))
        return self.span(int(a), int(b))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


MANIFEST = "part int, number int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, space: str = "drop", width: int = 2, files: int | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode (doc_id, text) and write token files to ``folder``; returns the manifest.

    The manifest has a row per file: part and number int, path, n_docs, n_tokens long; files follow each other
    by part and number. Texts move once, to range partitions of doc_id (nulls first) and, where many have
    the same id or none, of their texts' hashes. A task begins another file once one has
    ``file_tokens``, so it holds that many ids and one slice's, whatever its partition holds. A null
    text is empty, each document ends with ``end_id``; repeated doc_ids stay, ordered by hash and text. Further
    columns are ignored; no rows give no files. A file is written under its attempt's name and then renamed,
    so a task that runs again replaces it whole. ``width`` is the bytes of an id (2 below 65,536).
    """
    spark = docs.sparkSession
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.shared(tokenizer, space)
        part_number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        where, base = _open(folder)
        keys, ids, lengths, nulls, tokens, number = [], [], [], 0, 0, 0

        def finish() -> pa.RecordBatch:
            sizes = np.concatenate(lengths)
            name = f"tokens-{part_number:06d}-{number:06d}.bin"
            where.create_dir(base, recursive=True)
            temporary = f"{base}/_{name}-{attempt}-{os.getpid()}"
            with where.open_output_stream(temporary, compression=None) as out:
                for piece in pieces_of(np.concatenate(keys), sizes, ids, width, nulls):
                    out.write(piece)
            where.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part_number], pa.int32()), "number": pa.array([number], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([int(sizes.sum())], pa.int64())})

        for part in text_slices(batches, "text"):
            nulls += part.column("doc_id").null_count
            keys.append(part.column("doc_id").drop_null().to_numpy())
            found, at = encoder.encode(part.column("text"))
            ids.append(np.insert(found, at[1:], end_id).astype(f"<u{width}"))
            lengths.append(np.diff(at) + 1)
            tokens += len(ids[-1])
            if tokens >= file_tokens:
                yield finish()
                keys, ids, lengths, nulls, tokens, number = [], [], [], 0, 0, number + 1
        if keys:
            yield finish()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return dealt.mapInArrow(write, MANIFEST)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens, ids_crc32, one row per document.

    The manifest has one row per file, so the sums of the files before are taken on the driver. A
    task reads a file's boundaries, then the ids of a range of documents at a time.
    """
    spark = manifest.sparkSession
    before, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: (r["part"], r["number"])):
        rows.append((r["path"], before))
        before += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, at = _open(path)
                with where.open_input_file(at) as source:
                    file = TokenFile(lambda at, n: source.read_at(n, at))  # noqa: B023
                    for low in range(0, file.n, 10_000):
                        index = np.arange(low, min(file.n, low + 10_000))
                        start, end = file.bounds(index)
                        ids = file.span(int(start[0]), int(end[-1])).astype("<u4")
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip((start - start[0]).tolist(), (end - start[0]).tolist(), strict=True)]
                        keys = file.doc_ids(index)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.filled(0), pa.int64(), mask=np.ma.getmaskarray(keys)), pa.array(start + base), pa.array(end - start), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))
    return listed.mapInArrow(read, schema)


def token_folder(docs: DataFrame) -> str:
    return new_path(docs.sparkSession, "tokens")
