"""Progressive JPEG in NumPy: coefficients from scans, inverse transform, chroma upsampling, RGB.

The decoder takes baseline and progressive Huffman files. Every scan adds to the components'
coefficient arrays: spectral selection says which band of a block, successive approximation at
which bit. Runs of ended blocks are refined all at once, and scans whose codes and extra bits are
of one total length (their tables say so) are read as arrays; everything else goes bit by bit.

The encoder stores any bytes losslessly in the format's own unit, the quantised coefficient: 64
bytes are one component's coefficients of one 8 x 8 block. Byte b becomes b, or b - 255
below 128, so every magnitude is 128 to 255 and its sign and low bits are b's. It writes a DC scan
and two bands of AC scans without the last bit, then the scans that refine it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, text_slices

UNIT = 192
BANDS = ((1, 5), (6, 63))
#: Fixed by the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_x = np.arange(8)
_DCT = np.cos((2 * _x[:, None] + 1) * _x[None] * np.pi / 16) * np.where(_x == 0, np.sqrt(0.5), 1) / 2
#: Samples of a block (row-major) = coefficients in zigzag order @ IDCT.
IDCT = np.kron(_DCT, _DCT).T[ZIGZAG].astype(np.float32)


class BadImage(ValueError):
    """The bytes are no image that this module reads."""


#: What a damaged file leads to.
UNREADABLE = (BadImage, IndexError, struct.error, KeyError, ValueError, StopIteration, AttributeError, TypeError)


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled with spaces to a positive multiple of 192, and their number before."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


# -- encoding ---------------------------------------------------------------------------------


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _huffman(kind: int, by_length: dict[int, list[int]]) -> bytes:
    counts = bytes(len(by_length.get(n, [])) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for n in sorted(by_length) for s in by_length[n]))


def _scan(components: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *(x for c in components for x in (c, 0)), start, end, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\0")


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :]


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


#: DC: size s has a code of 9 - s bits, so that code and extra bits are 9 bits for every size.
DC_TABLE = {9 - s: [s] for s in range(9)}
#: AC, first scans: one code, "0", for a coefficient of 7 bits without zeros before it.
AC_TABLE = {1: [0x07]}
#: AC, refining scans: runs of ended blocks.
END_TABLE = {4: [n << 4 for n in range(15)]}
MAX_RUN = 32767


def _planes(data: bytes, subsampled: bool) -> list[Component]:
    """The components whose coefficients are ``data``, filled with 32 to a whole image.

    At full size the blocks of 64 bytes go to the three components in turn. Subsampled, four of six are luma
    and the first two thirds of the bytes (of the filled payload), the others are one of each chroma.
    """
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 64)
    each = 6 if subsampled else 3
    units = -(-len(blocks) // each)
    across = -(-units // 4095)
    units = across * -(-units // across)
    filled = np.full((each * units, 64), 32, np.uint8)
    filled[: len(blocks)] = blocks
    parts = np.split(filled, [4 * units, 5 * units]) if subsampled else list(filled.reshape(-1, 3, 64).swapaxes(0, 1))
    found = []
    for i, part in enumerate(parts):
        n = 2 if subsampled and not i else 1
        values = part.astype(np.int32)
        values -= np.where(values < 128, 255, 0)
        found.append(Component(i + 1, n, n, 0, n * across, n * units // across, n * across, n * units // across, values))
    return found


def encode(data: bytes, subsampled: bool = False) -> bytes:
    """A progressive JPEG whose coefficients are ``data`` (a positive multiple of 192 bytes).

    ``subsampled``: with two chroma planes of half the width and height.
    """
    if not data or len(data) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    units = _planes(data, subsampled)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(data)), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 8 * units[0].down, 8 * units[0].across, 3) + bytes(x for c in units for x in (c.number, c.h << 4 | c.v, 0))))
    out += [_huffman(0x00, DC_TABLE), _huffman(0x10, AC_TABLE)]
    which, block = _order(units)
    dc, diff = np.zeros(len(which), np.int32), np.zeros(len(which), np.int32)
    for i, c in enumerate(units):
        mine = which == i
        dc[mine] = c.coefficients[block[mine], 0]
        diff[mine] = np.diff(dc[mine] >> 1, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float64))[1]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = (1 << (9 - size)) - 2  # of 9 - size bits: ones, then a zero
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, _packed(_bits((code << size) | extra, 9).ravel())))
    raw = [(c.coefficients & 255).astype(np.uint8) for c in units]  # value + 256 for negative ones
    raw = [np.where(c.coefficients < 0, x - 1, x).astype(np.uint8) for x, c in zip(raw, units, strict=True)]
    for a, b in BANDS:
        for c, x in zip(units, raw, strict=True):
            out.append(_scan([c.number], a, b, 0, 1, (x[:, a : b + 1] >> 1).tobytes()))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, _packed((dc & 1).astype(np.uint8))))
    out.append(_huffman(0x10, END_TABLE))
    for c, x in zip(units, raw, strict=True):
        low = (x ^ (x >> 7) ^ 1) & 1  # the last bit of the magnitude
        bits = []
        for at in range(0, len(low), MAX_RUN):
            run = min(MAX_RUN, len(low) - at)
            n = run.bit_length() - 1
            bits += [_bits(np.array([n]), 4).ravel(), _bits(np.array([run - (1 << n)]), n).ravel(), low[at : at + run, 1:].ravel()]
        out.append(_scan([c.number], 1, 63, 1, 0, _packed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


# -- decoding ---------------------------------------------------------------------------------


class Table:
    """A Huffman table: symbols by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.codes[length, code] = s
                code += 1
            at += n
            code <<= 1

        lengths = {length + (s & 15) for (length, _), s in self.codes.items()}
        #: The bits of every code with its extra bits if they are the same for all symbols, else 0.
        self.constant = lengths.pop() if len(lengths) == 1 else 0

    @cached_property
    def values(self) -> np.ndarray:
        """By code and extra bits: the signed number they stand for (constant lengths only)."""
        out = np.full(1 << self.constant, 1 << 20, np.int32)
        for (_, code), s in self.codes.items():
            e, s = np.arange(1 << (s & 15)), s & 15
            out[(code << s) + e] = np.where(e >> max(0, s - 1), e, e - (1 << s) + 1) if s else 0
        return out


_table = lru_cache(256)(Table)


class Reader:
    def __init__(self, data: bytes):
        self.raw = data
        self.at = 0

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.raw, np.uint8))

    def take(self, n: int) -> np.ndarray:
        if self.at + n > len(self.bits):
            raise BadImage("a scan ends early")
        self.at += n
        return self.bits[self.at - n : self.at]

    def number(self, n: int) -> int:
        value = 0
        for b in self.take(n).tolist():
            value = value << 1 | b
        return value

    def symbol(self, table: Table) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.take(1)[0])
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise BadImage("no such code")

    def signed(self, size: int) -> int:
        value = self.number(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks, filled to whole units
    down: int = 0
    own_across: int = 0  # blocks of the component alone
    own_down: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))

    @cached_property
    def own(self) -> np.ndarray:
        """The blocks of a scan of this component alone."""
        return (np.arange(self.own_down)[:, None] * self.across + np.arange(self.own_across)).ravel()


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        size = int(self.comment.removeprefix(b"payload "))
        planes = [c.coefficients for c in self.components]
        values = np.concatenate(planes) if len({len(p) for p in planes}) > 1 else np.stack(planes, axis=1)
        return (values + np.where(values < 0, 255, 0)).astype(np.uint8).tobytes()[:size]

    def rgb(self) -> np.ndarray:
        """height x width x 3 of uint8: dequantised, inverse-transformed, chroma repeated to full size."""
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        planes = []
        for c in self.components:
            samples = (c.coefficients * self.quant[c.quant]).astype(np.float32) @ IDCT
            plane = samples.reshape(c.down, c.across, 8, 8).swapaxes(1, 2).reshape(8 * c.down, 8 * c.across)
            if (h, v) != (c.h, c.v):
                plane = plane.repeat(v // c.v, 0).repeat(h // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        y = planes[0] + np.float32(128.5)
        if len(planes) == 1:
            parts = [y, y, y]
        else:
            cb, cr = planes[1:3]
            parts = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, part in enumerate(parts):
            np.clip(part, 0, 255, out=part)
            out[:, :, i] = part
        return out


def _dc_scan(r: Reader, units: list[Component], tables: list[Table], high: int, low: int, order: np.ndarray) -> None:
    """``order``: (component in the scan, block) of each coded block in turn."""
    which, block = order
    if high:
        bits = r.take(len(block))
        for i, c in enumerate(units):
            mine = which == i
            c.coefficients[block[mine], 0] |= bits[mine].astype(np.int32) << low
        return
    if all(t is tables[0] for t in tables) and 0 < (n := tables[0].constant) <= 16:
        diff = tables[0].values[r.take(n * len(block)).reshape(-1, n) @ (1 << np.arange(n - 1, -1, -1))]
        if len(diff) and diff.max() >= 1 << 20:
            raise BadImage("no such code")
    else:
        diff = np.array([r.signed(r.symbol(tables[i])) for i in which.tolist()], np.int32)
    for i, c in enumerate(units):
        mine = which == i
        c.coefficients[block[mine], 0] = np.cumsum(diff[mine]) << low


def _ac_first(r: Reader, c: Component, blocks: np.ndarray, table: Table, a: int, b: int, low: int) -> None:
    only = list(table.codes.values())
    if len(only) == 1 and 0 < only[0] < 16 and (n := table.constant) <= 16:
        size = only[0]
        count = len(blocks) * (b - a + 1)
        if n == 8 and count <= len(r.raw):
            words = np.frombuffer(r.raw, np.uint8)[:count].astype(np.int32)
        else:
            words = r.take(n * count).reshape(-1, n) @ (1 << np.arange(n - 1, -1, -1))
        if len(words) and words.max() >> size:
            raise BadImage("no such code")
        value = np.where(words >> (size - 1), words, words - (1 << size) + 1)
        c.coefficients[blocks[:, None], np.arange(a, b + 1)] = value.reshape(len(blocks), -1) << low
        return
    ended = 0
    for block in blocks.tolist():
        if ended:
            ended -= 1
            continue
        k = a
        while k <= b:
            run, size = divmod(r.symbol(table), 16)
            if size:
                k += run
                if k > b:
                    raise BadImage("a run leaves the band")
                c.coefficients[block, k] = r.signed(size) << low
            elif run < 15:
                ended = (1 << run) + (r.number(run) if run else 0) - 1
                break
            else:
                k += 15
            k += 1


def _refine(r: Reader, values: np.ndarray, low: int) -> np.ndarray:
    """Correct the non-zero ones of these coefficients by one bit each."""
    known = values != 0
    step = np.sign(values) << low
    flat = values.copy()
    flat[known] += step[known] * r.take(int(known.sum()))
    return flat


def _ac_refine(r: Reader, c: Component, blocks: np.ndarray, table: Table, a: int, b: int, low: int) -> None:
    at = 0
    while at < len(blocks):
        k, row = a, c.coefficients[blocks[at]]
        while k <= b:
            run, size = divmod(r.symbol(table), 16)
            if not size and run < 15:  # this block's rest and the run's further blocks end here
                more = (1 << run) + (r.number(run) if run else 0) - 1
                row[k : b + 1] = _refine(r, row[k : b + 1], low)
                rest = blocks[at + 1 : at + 1 + more]
                if len(rest):
                    band = c.coefficients[rest][:, a : b + 1]
                    c.coefficients[rest, a : b + 1] = _refine(r, band.ravel(), low).reshape(band.shape)
                at += more
                break
            new = (1 if r.number(1) else -1) << low if size else 0
            while k <= b:
                if row[k]:
                    row[k : k + 1] = _refine(r, row[k : k + 1], low)
                elif run:
                    run -= 1
                else:
                    row[k] = new
                    break
                k += 1
            k += 1
        at += 1


def _baseline(r: Reader, units: list, dc: list[Table], ac: list[Table], order: np.ndarray) -> None:
    last = [0] * len(units)
    for i, block in zip(*(x.tolist() for x in order), strict=True):
        row = units[i].coefficients[block]
        last[i] += r.signed(r.symbol(dc[i]))
        row[0], k = last[i], 1
        while k < 64:
            run, size = divmod(r.symbol(ac[i]), 16)
            if not size and run < 15:
                break
            k += run
            if size:
                row[k] = r.signed(size)
            k += 1


def _frame(image: Image, data: bytes) -> None:
    _, image.height, image.width, n = struct.unpack(">BHHB", data[:6])
    image.components = [Component(data[6 + 3 * i], data[7 + 3 * i] >> 4, data[7 + 3 * i] & 15, data[8 + 3 * i]) for i in range(n)]
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        c.across, c.down = -(-image.width // (8 * h)) * c.h, -(-image.height // (8 * v)) * c.v
        c.own_across, c.own_down = -(-image.width * c.h // (8 * h)), -(-image.height * c.v // (8 * v))
        c.coefficients = np.zeros((c.across * c.down, 64), np.int32)


def _order(units: list[Component]) -> np.ndarray:
    """Component and block of each block of a scan, in the order in which they are coded."""
    if len(units) == 1:
        return np.stack([np.zeros(len(units[0].own), np.int64), units[0].own])
    shape = tuple((c.h, c.v, c.across, c.down) for c in units)
    return (_small_order if sum(c.across * c.down for c in units) <= 4096 else _unit_order)(shape)


def _unit_order(shape: tuple[tuple[int, int, int, int], ...]) -> np.ndarray:
    """The order of several components' (h, v, across, down) blocks: unit by unit."""
    if all(h == v == 1 for h, v, _, _ in shape):
        n = shape[0][2] * shape[0][3]
        return np.stack([np.tile(np.arange(len(shape)), n), np.repeat(np.arange(n), len(shape))])
    parts = []
    for i, (h, v, across, down) in enumerate(shape):
        y, x = np.divmod(np.arange(across * down), across)
        unit = (y // v) * (across // h) + x // h
        parts.append(np.stack([unit, np.full(len(x), i), y % v * h + x % h, np.arange(len(x))]))
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort(rows[2::-1])]
    return rows[[1, 3]]


_small_order = lru_cache(512)(_unit_order)


def decode(data: bytes) -> Image:
    """Parse a file into coefficient arrays; raises BadImage where it isn't one."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no start of image")
    image, at, tables, progressive, interval = Image(), 2, {}, False, 0
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise BadImage("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            _frame(image, body)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif 0xC3 <= marker <= 0xCF:
            raise BadImage("a coding that this module doesn't read")
        elif marker == 0xDA:
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            if end < 0:
                raise BadImage("the file ends in a scan")
            _one_scan(image, body, data[at:end], tables, progressive, interval)
            at = end
    raise BadImage("no end of image")


def _one_scan(image: Image, head: bytes, data: bytes, tables: dict[int, Table], progressive: bool, interval: int) -> None:
    n = head[0]
    units, dc, ac = [], [], []
    for i in range(n):
        c = next(c for c in image.components if c.number == head[1 + 2 * i])
        units.append(c)
        dc.append(tables.get(head[2 + 2 * i] >> 4))
        ac.append(tables.get(0x10 | head[2 + 2 * i] & 15))
    a, b, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    order = _order(units)
    each = interval * (1 if n == 1 else sum(c.h * c.v for c in units)) if interval else order.shape[1]
    parts = [data]
    if interval:  # restart markers cut the scan into parts that are coded each for itself
        parts, from_ = [], 0
        for i in range(len(data) - 1):
            if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                parts.append(data[from_:i])
                from_ = i + 2
        parts.append(data[from_:])
    for i, part in enumerate(parts):
        r, now = Reader(part.replace(b"\xff\0", b"\xff")), order[:, i * each : (i + 1) * each]
        if not progressive:
            _baseline(r, units, dc, ac, now)
        elif a == 0:
            _dc_scan(r, units, dc, high, low, now)
        elif high:
            _ac_refine(r, units[0], now[1], ac[0], a, b, low)
        else:
            _ac_first(r, units[0], now[1], ac[0], a, b, low)


# -- columns ----------------------------------------------------------------------------------


def store_texts(docs: DataFrame, key: str = "doc_id", subsampled: bool = True) -> DataFrame:
    """(key, n_bytes long, media binary): each row's text as a progressive JPEG (see ``encode``).

    A null text is empty. Equal or null keys stay as rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("jpeg", dict)
        for part in text_slices(batches, "text", 2 << 20):
            data = [payload(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([n for _, n in data], pa.int64()), pa.array([encode(p, subsampled) for p, _ in data], pa.binary())], [key, "n_bytes", "media"])

    rows = docs.selectExpr(f"cast({key} as long) {key}", "cast(text as string) text")
    return rows.mapInArrow(run, f"{key} long, n_bytes long, media binary")


def load_images(media: DataFrame, column: str = "media", details: bool = False) -> DataFrame:
    """``media`` with width, height int and rgb binary (height x width x 3 samples) of each image.

    With ``details`` also payload binary, the bytes that ``encode`` stored, and means array<double>, of the
    channels. Null where the bytes are null or no image that can be read (or hold no payload).
    """
    extra = {"width": pa.int32(), "height": pa.int32(), "rgb": pa.binary()} | ({"payload": pa.binary(), "means": pa.list_(pa.float64())} if details else {})
    names = [f for f in media.schema.names if f not in extra]
    own = media.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column, 1 << 20):
            rows: list[tuple] = []
            for data in part.column(column).to_pylist():
                try:
                    image = decode(data or b"")
                    tensor = image.rgb()
                    more = (image.payload(), tensor.reshape(-1, 3).mean(0).tolist()) if details else ()
                    rows.append((tensor.shape[1], tensor.shape[0], tensor.tobytes(), *more))
                except UNREADABLE:
                    rows.append((None,) * len(extra))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), extra.values(), strict=True)]], [*names, *extra])

    what = "width int, height int, rgb binary" + ", payload binary, means array<double>" * details
    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), what]))


def digest(images: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of stored texts (key, n_bytes, media, and what ``load_images`` adds with details).

    The feature, of the RGB column, is the tensor's shape, the means of its channels and a digest of all
    samples. Rows without an image that can be read have nulls.
    """
    there = F.col("payload").isNotNull()
    means = F.array_join(F.transform("means", lambda x: F.format_number(x, 4)), ",")
    return images.select(
        key,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.when(there, F.octet_length("media").cast("long")).alias("media_bytes"),
        F.when(there, F.sha2("media", 256)).alias("media_sha256"),
        F.when(there, F.concat(F.concat_ws("x", "height", "width", F.lit(3)), F.lit(":"), means, F.lit(":"), F.lower(F.hex(F.crc32("rgb"))))).alias("feature"),
    )
