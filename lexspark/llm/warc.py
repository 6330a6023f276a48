"""WARC archives: a writer that turns repeated payloads into revisit records, and a Spark data source.

The source (format "warc") plans partitions of whole files, or of parts of large files where an index
beside the archive (its name and ".idx": places where records begin, as 64-bit numbers) says how to cut it.
It takes over predicates on the record type and on header columns, and reads each record's headers first. A record that the predicates
rule out is skipped: in plain files by a seek over its block, in compressed ones by dropping the
rest of its member undecoded, where the member's gzip header states its lengths (extra field SL, as
the writer does); members of other writers are inflated. Without the option ``payload`` no block is kept at all.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

LEAST = 1000  # payload bytes from which an equal payload becomes a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:lexspark:page:"
#: Header columns of the source, by the header's name in lower case.
HEADERS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date", "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to", "content-type": "content_type"}
COLUMNS = [*HEADERS.values(), "payload_sha1", "content_length", "http_length", "payload"]
SCHEMA = ", ".join(f"{c} string" for c in HEADERS.values()) + ", payload_sha1 string, content_length long, http_length long, payload binary"
INDEX_BYTES = 32 << 20  # of an archive between two places that its index names


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the payload's HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD}{'null' if page is None else page}>", "WARC-Date: 2026-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose header has its compressed and plain lengths in an extra field, SL.

    Lengths from 4 GiB don't fit the field and are left out.
    """
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body)
    if max(size, len(data)) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<HccHII", 12, b"S", b"L", 8, size, len(data)) + body


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, size, refers_to) of payloads of ``least`` bytes or more that a larger page_id has too."""
    rows = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("b")).select("page_id", F.sha1("b").alias("digest"), F.octet_length("b").alias("size")).where(F.col("size") >= least)
    groups = rows.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, repeated: DataFrame, compress: bool = True, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to files in ``folder``, one a task, with their indexes; returns path and records.

    ``repeated`` (see ``revisits``) should be a table of known size: as long as it is small Spark
    sends it to all tasks, and pages don't move. A null html is an empty payload; a null page_id is
    a response; rows of one page_id are written each for itself, as a revisit only if its own
    payload is that of ``refers_to``; a null url has no target.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rows = rows.join(repeated, ["page_id", "digest", "size"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, attempt, n, out = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None
        where, base = _open(folder)
        name = f"pages-{number:06d}.warc" + ".gz" * compress
        temporary = f"{base}/_{name}-{attempt}-{os.getpid()}"
        places, size = [0], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(temporary, compression=None)
                if size - places[-1] >= index_bytes:
                    places.append(size)
                data = record(*row)
                if compress:
                    data = member(data)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            if len(places) > 1:
                with where.open_output_stream(f"{temporary}.idx", compression=None) as index:
                    index.write(struct.pack(f"<{len(places)}Q", *places))
                where.move(f"{temporary}.idx", f"{base}/{name}.idx")
            where.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "path string, records long")


@dataclass
class Files(InputPartition):
    """Parts of files: path, first byte and the byte after the last (None: to the end)."""

    parts: list[tuple[str, int, int | None]]

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        self.parts = parts


class Part:
    """The bytes of a file from ``start`` to ``end``, as a file of its own."""

    def __init__(self, source: pa.NativeFile, start: int, end: int | None):
        self.source, self.start, self.end, self.at = source, start, end, 0
        if start:
            source.seek(start)

    def read(self, n: int) -> bytes:
        data = self.source.read(n if self.end is None else max(0, min(n, self.end - self.start - self.at)))
        self.at += len(data)
        return data

    def seek(self, at: int) -> None:
        self.source.seek(self.start + at)
        self.at = at

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return self.source.seekable()


class Stream:
    """Bytes of a file, plain or of gzip members, with a way past a record's rest.

    A member that states its lengths and ends with its record is dropped undecoded once the
    record's headers are read.
    """

    def __init__(self, source: pa.NativeFile, packed: bool):
        self.source, self.packed = source, packed
        self.buffer, self.inflate, self.raw = b"", None, b""
        self.at = 0  # bytes of a packed source that are read or passed
        self.end, self.plain, self.decoded = None, 0, 0  # of a member: its end in the source, length, bytes inflated

    def _fill(self) -> bool:
        data = self.source.read(1 << 16)
        self.raw += data
        self.at += len(data)
        return bool(data)

    def _start(self) -> None:
        """Begin a member; the lengths are known if the first extra field is SL."""
        self.inflate, self.end, self.decoded = zlib.decompressobj(31), None, 0
        while len(self.raw) < 24 and self._fill():
            pass
        if len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[12:16] == b"SL\x08\0":
            size, self.plain = struct.unpack("<II", self.raw[16:24])
            self.end = self.at - len(self.raw) + size

    def _more(self) -> bool:
        if not self.packed:
            data = self.source.read(1 << 16)
            self.buffer += data
            return bool(data)
        while True:
            if not self.raw and not self._fill():
                return False
            if self.inflate is None:
                self._start()
            data = self.inflate.decompress(self.raw, 1 << 16)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = None
            if data:
                self.buffer += data
                self.decoded += len(data)
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("a record's headers don't end")
                return None
        found, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("a record's block ends early")
            parts.append(self.buffer)
            have += len(self.buffer)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        if not self.packed and n > len(self.buffer) and self.source.seekable():
            self.source.seek(self.source.tell() + n - len(self.buffer))
            self.buffer = b""
            return
        if self.inflate is not None and self.end is not None and n > len(self.buffer) and self.plain - self.decoded == n - len(self.buffer):
            self._drop()
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self._more():
                raise ValueError("a record's block ends early")
        self.buffer = self.buffer[n:]

    def _drop(self) -> None:
        """Go to the member's end without inflating."""
        self.buffer, self.inflate = b"", None
        if self.at < self.end and self.source.seekable():
            self.source.seek(self.end)
            self.at, self.raw = self.end, b""
        while self.at < self.end:
            self.raw = b""
            if not self._fill():
                raise ValueError("a record's block ends early")
        self.raw = self.raw[len(self.raw) - (self.at - self.end) :]


def hex_digest(stated: str | None) -> str | None:
    """A header's SHA-1, in base32 or in hexadecimal digits, as the latter; null for other algorithms and forms."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)).hex()
    except ValueError:
        return None


def records(stream: Stream, wanted: dict[str, set], payload: bool) -> Iterator[tuple]:
    """The records whose header columns have the wanted values, as COLUMNS.

    Fails on an archive that isn't one: no version line, no length of a block, or an end within a record.
    """
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace").lstrip()).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one must be")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("content-length", "").isdecimal():
            raise ValueError("a WARC record doesn't state the length of its block")
        size = int(fields["content-length"])
        row = {column: fields.get(name) for name, column in HEADERS.items()}
        if any(row[c] not in values for c, values in wanted.items()):
            stream.skip(size + 4)
            continue
        http, left = None, size
        body = None
        if (row["content_type"] or "").startswith("application/http") and row["record_type"] in ("response", "revisit"):
            top = stream.until(b"\r\n\r\n") or b""
            left -= len(top) + 4
            found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", top)
            http = int(found[1]) if found else None
        if payload:
            body = stream.take(left)
            left = 0
        stream.skip(left + 4)
        yield (*row.values(), hex_digest(row["payload_digest"]), size, http, body)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Take equality and membership of header columns, which no null has; hand the rest back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS.values() and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        where, base = _open(self.path)
        info = where.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if re.search(r"\.warc(\.gz)?$", f.base_name) and not f.base_name.startswith(("_", "."))]
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        out: list[list[tuple[str, int, int | None]]] = []
        room = 0
        for f in sorted(files, key=lambda f: f.path):
            places = [0]
            if f.size > self.target and where.get_file_info(f"{f.path}.idx").type == fs.FileType.File:
                with where.open_input_stream(f"{f.path}.idx", compression=None) as index:
                    places = [x for (x,) in struct.iter_unpack("<Q", index.read())]
            for start, end in zip(places, [*places[1:], None], strict=True):
                size = (f.size if end is None else end) - start
                if not out or room < size:
                    out.append([])
                    room = self.target
                out[-1].append((prefix + f.path, start, end))
                room -= size
        return [Files(parts) for parts in out or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * (len(HEADERS) + 1), pa.int64(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)

        for path, start, end in partition.parts:
            where, at = _open(path)
            rows, size = [], 0
            with where.open_input_file(at) as source:
                for row in records(Stream(Part(source, start, end), path.endswith(".gz")), self.wanted, self.payload):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


class WarcSource(DataSource):
    """Options: path (a folder or file), payload (true: keep blocks), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("warc")`` known, with predicates pushed down."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner need not import this module
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_digests(archive: DataFrame) -> DataFrame:
    """Per record of an archive that ``write_warc`` made: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    whole = F.col("record_type") == "response"
    number = lambda c: F.regexp_extract(c, RECORD + r"(-?\d+)>", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return archive.select(
        as_long("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        as_long("refers_to").alias("refers_to"),
    )
