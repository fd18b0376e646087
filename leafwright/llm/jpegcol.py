"""Media columns: progressive JPEG files in a binary column, decoded to full-resolution RGB tensors in numpy.

The decoder accumulates every scan of a file, whether it selects a part of the spectrum or refines the bits of
an earlier scan, into coefficient arrays; it then dequantises, applies the inverse cosine transform as one
matrix product, upsamples chroma and converts to RGB. Entropy decoding is general; runs of equal symbols, and
the correction bits of end-of-band runs, are taken many blocks at a time.

The encoder stores a payload of bytes losslessly. Its unit is the quantised coefficient (step 1): byte b is
coefficient 256 + b, 64 bytes a block in zigzag order, blocks of Y, Cb and Cr planes one after another at
4:2:0. Scans are those of common encoders: DC, Y low band, Cb, Cr, Y high band, each without the last bit,
and then a refinement scan for each.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.llm.common import map_batches

_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
#: The script of scans: components, first and last coefficient, high and low bit.
_SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]
#: Huffman tables as (code lengths of 1 to 16 bits, symbols): DC sizes and end-of-band runs of four bits, one coefficient size.
_DC_TABLE = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
_AC_FIRST = (bytes([1] + [0] * 15), bytes([8]))
_AC_REFINE = (bytes([0, 0, 0, 15] + [0] * 12), bytes(k << 4 for k in range(15)))
_OFFSET = 256


def _zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


_ZIGZAG = _zigzag()


def _cosines() -> np.ndarray:
    """Matrix from 64 coefficients in zigzag order to 64 samples."""
    n = np.arange(8)
    one = np.sqrt(np.where(n == 0, 0.125, 0.25))[:, None] * np.cos((2 * n + 1) * n[:, None] * np.pi / 16)
    return np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)[_ZIGZAG].astype(np.float32)


_COSINES = _cosines()


@lru_cache(maxsize=256)
def _interleaved(sampling: tuple[tuple[int, int], ...], rows: int, columns: int) -> list[np.ndarray]:
    """For each component its blocks in the order of an interleaved scan (rows x columns units)."""
    out = []
    for h, v in sampling:
        y, x, dy, dx = np.ogrid[:rows, :columns, :v, :h]
        out.append(((y * v + dy) * columns * h + x * h + dx).reshape(rows * columns, v * h))
    return out


# -- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _closed(bits: np.ndarray) -> bytes:
    """Whole bytes, the last filled with ones, and a zero byte after each 0xFF."""
    rest = -len(bits) % 8
    if rest:
        bits = np.concatenate([bits, np.ones(rest, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _dc_bits(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Differences within a component (``by``), each a code of four bits and as many bits as its size."""
    diff = values.copy()
    for c in np.unique(by):
        at = np.flatnonzero(by == c)
        diff[at[1:]] -= values[at[:-1]]
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1)
    length, number = size + 4, (size << size) | extra
    place = np.arange(15)
    grid = (number[:, None] >> np.maximum(length[:, None] - 1 - place, 0)) & 1
    return grid[place < length[:, None]].astype(np.uint8)


def geometry(payload_bytes: int) -> tuple[int, int]:
    """Rows and columns of units of six blocks that hold so many bytes."""
    units = -(-payload_bytes // 384)
    columns = min(1 << (max(units, 1).bit_length() - 1) // 2, 4095)
    rows = -(-units // columns)
    if rows > 4095:
        raise ValueError("a file holds 6 GB at most")
    return rows, columns


def encode(payload: bytes, length: int) -> bytes:
    """A progressive JPEG of a payload (a positive multiple of 64 bytes); ``length`` of them are its own."""
    rows, columns = geometry(len(payload))
    units = rows * columns
    blocks = np.zeros((units * 6, 64), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = [blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :]]
    order = _interleaved(((2, 2), (1, 1), (1, 1)), rows, columns)
    dc = np.concatenate([p[o, 0] for p, o in zip(planes, order)], axis=1).reshape(-1)
    by = np.tile(np.array([0, 0, 0, 0, 1, 2]), units)
    out = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xFE, b"payload %d %d" % (length, len(payload))),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, b"\0" + _DC_TABLE[0] + _DC_TABLE[1] + b"\x10" + _AC_FIRST[0] + _AC_FIRST[1] + b"\x11" + _AC_REFINE[0] + _AC_REFINE[1]),
    ]
    for parts, first, last, high, low in _SCRIPT:
        out.append(_segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, 0x01 if high else 0x00)), first, last, high << 4 | low])))
        if not first:
            bits = (dc & 1) if high else _dc_bits((dc.astype(np.int64) + _OFFSET) >> 1, by)
        else:
            band = planes[parts[0]][:, first : last + 1]
            if high:
                bits = []
                for at in range(0, len(band), 32767):
                    some = band[at : at + 32767] & 1
                    n = len(some).bit_length() - 1  # blocks in the run: a one and n more bits
                    head = (n << n | (len(some) - (1 << n))) if n else 0
                    bits += [np.array([head >> k & 1 for k in range(n + 3, -1, -1)], np.uint8), some.reshape(-1)]
                bits = np.concatenate(bits)
            else:
                grid = np.empty((*band.shape, 9), np.uint8)
                grid[..., 0], grid[..., 1] = 0, 1
                grid[..., 2:] = np.unpackbits(np.ascontiguousarray(band)[..., None], axis=2)[..., :7]
                bits = grid.reshape(-1)
        out.append(_closed(bits))
    return b"".join([*out, b"\xff\xd9"])


# -- decoding


@lru_cache(maxsize=64)
def _codes(lengths: bytes, symbols: bytes) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """For each 16-bit window the code's length and symbol (0: no code), and the code of each symbol."""
    size, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    by_symbol = {}
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            at = slice(code << (16 - n), (code + 1) << (16 - n))
            size[at], symbol[at] = n, symbols[k]
            by_symbol[symbols[k]] = (n, code)
            code, k = code + 1, k + 1
        code <<= 1
    return size.tolist(), symbol.tolist(), by_symbol


class _Bits:
    """A scan's bits, and windows into them."""

    def __init__(self, data: bytes):
        self.data = data + b"\xff" * 8
        self.bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        self.at = 0

    def words(self) -> np.ndarray:
        """The 32 bits from each byte on."""
        wide = np.frombuffer(self.data, np.uint8).astype(np.int64)
        return (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]

    def window(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 4]) >> (16 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | bit
        self.at += n
        return value

    def symbol(self, table) -> int:
        w = self.window()
        if not table[0][w]:
            raise ValueError("a code that the file does not define")
        self.at += table[0][w]
        return table[1][w]


def _signed(value, size):
    return np.where(value >> np.maximum(size - 1, 0) & 1, value, value - (1 << size) + 1) * (size > 0)


def _dc_first(bits: _Bits, tables: list, targets: list[np.ndarray], coefficients: list[np.ndarray], low: int) -> None:
    """``targets``: each component's blocks by scan unit (units x blocks in a unit)."""
    plan = [k for k, t in enumerate(targets) for _ in range(t.shape[1])]
    units, wide, at = len(targets[0]), bits.words(), 0
    words = wide.tolist()
    starts, sizes = [], []
    step = [(tables[k][0], tables[k][1]) for k in plan]
    for _ in range(units):
        for length, symbol in step:
            w = (words[at >> 3] >> (16 - (at & 7))) & 0xFFFF
            s = symbol[w]
            at += length[w]
            starts.append(at)
            sizes.append(s)
            at += s
    start, size = np.array(starts), np.array(sizes)
    extra = (wide[start >> 3] >> (32 - (start & 7) - size)) & ((1 << size) - 1)
    diff = _signed(extra, size).reshape(units, len(plan))
    k = 0
    for c, t in enumerate(targets):
        values = np.cumsum(diff[:, k : k + t.shape[1]].reshape(-1))
        coefficients[c][t.reshape(-1), 0] = values << low
        k += t.shape[1]


def _dc_refine(bits: _Bits, targets: list[np.ndarray], coefficients: list[np.ndarray], low: int) -> None:
    width = sum(t.shape[1] for t in targets)
    found = bits.bits[: len(targets[0]) * width].reshape(-1, width).astype(np.int16)
    k = 0
    for c, t in enumerate(targets):
        coefficients[c][t.reshape(-1), 0] |= found[:, k : k + t.shape[1]].reshape(-1) << low
        k += t.shape[1]


def _uniform(bits: _Bits, table, blocks: int, width: int) -> tuple[int, np.ndarray | None]:
    """How many whole blocks ahead are made of one symbol without a zero run, and their coefficients."""
    symbol = table[1][bits.window()]
    if not 0 < symbol < 16:
        return 0, None
    length, code = table[2][symbol]
    stride = length + symbol
    most = min(blocks, (len(bits.bits) - bits.at) // (stride * width))
    tried = 1
    pattern = np.array([code >> k & 1 for k in range(length - 1, -1, -1)], np.uint8)
    good = 0
    while good < most:  # a block first, then ever more
        n = min(tried, most - good)
        part = bits.bits[bits.at + good * width * stride : bits.at + (good + n) * width * stride].reshape(n * width, stride)
        same = part[:, 0] == pattern[0]
        for k in range(1, length):
            same &= part[:, k] == pattern[k]
        whole = n if same.all() else int(np.argmin(same)) // width
        good += whole
        if whole < n:
            break
        tried *= 256
    if not good:
        return 0, None
    part = bits.bits[bits.at : bits.at + good * width * stride].reshape(-1, stride)[:, length:]
    pad = -symbol % 8
    if symbol <= 8:
        value = np.packbits(part, axis=1)[:, 0].astype(np.int16) >> pad
    else:
        two = np.packbits(part, axis=1).astype(np.int32)
        value = (two[:, 0] << 8 | two[:, 1]) >> pad
    bits.at += good * width * stride
    if (value >> (symbol - 1)).all():  # all positive
        return good, value.reshape(good, width)
    return good, _signed(value, symbol).reshape(good, width)


def _ac_first(bits: _Bits, table, target: np.ndarray, coefficients: np.ndarray, first: int, last: int, low: int) -> None:
    block, width, blocks = 0, last - first + 1, len(target)
    while block < blocks:
        good, values = _uniform(bits, table, blocks - block, width)
        if good:
            coefficients[target[block : block + good], first : last + 1] = values << low
            block += good
            continue
        k, run = first, 0
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                coefficients[target[block], k] = int(_signed(np.int64(bits.take(size)), size)) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros)
                break
        block += max(1, run)


def _correct(bits: _Bits, part: np.ndarray, low: int) -> np.ndarray:
    """One more bit for each coefficient that is not zero yet."""
    live = part != 0
    n = int(np.count_nonzero(live))
    found = bits.bits[bits.at : bits.at + n].astype(part.dtype) << low
    bits.at += n
    if n == part.size:
        more = found.reshape(part.shape)
    else:
        more = np.zeros_like(part)
        more[live] = found
    return part + np.where(part < 0, -more, more)


def _ac_refine(bits: _Bits, table, target: np.ndarray, coefficients: np.ndarray, first: int, last: int, low: int) -> None:
    block, blocks = 0, len(target)
    while block < blocks:
        row, k, run = target[block], first, 0
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            new = (1 if bits.take(1) else -1) << low if size else 0
            while k <= last:  # pass ``zeros`` coefficients that are still zero, correcting the others
                value = int(coefficients[row, k])
                if value:
                    if bits.take(1):
                        coefficients[row, k] = value + ((1 if value > 0 else -1) << low)
                elif zeros:
                    zeros -= 1
                else:
                    coefficients[row, k] = new
                    k += 1
                    break
                k += 1
        if run:
            coefficients[row, k : last + 1] = _correct(bits, coefficients[row, k : last + 1].copy(), low)
            rest = target[block + 1 : block + run]
            if len(rest):
                coefficients[rest, first : last + 1] = _correct(bits, coefficients[rest, first : last + 1], low)
        block += max(1, run)


class Picture:
    """A decoded file: coefficient arrays of its components, and what is needed to show them."""

    def __init__(self, data: bytes):
        self.comment = b""
        tables: dict[int, tuple] = {}
        quant: dict[int, np.ndarray] = {}
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = _MARKER.search(data, at).start()
                self._scan(body, data[at:end].replace(b"\xff\x00", b"\xff"), tables)
                at = end
            elif marker == 0xDD or 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive Huffman files without restart intervals are read")
        self.quant = [quant[q] for q in self._tables]

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3):
            raise ValueError("8-bit grey or colour only")
        parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
        self.ids = [p[0] for p in parts]
        self.sampling = tuple((p[1] >> 4, p[1] & 15) for p in parts) if n > 1 else ((1, 1),)
        self._tables = [p[2] for p in parts]
        self.most = tuple(max(s[k] for s in self.sampling) for k in (0, 1))
        self.columns, self.rows = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        self.coefficients = [np.zeros((self.rows * v * self.columns * h, 64), np.int16) for h, v in self.sampling]

    def _scan(self, body: bytes, data: bytes, tables: dict) -> None:
        n = body[0]
        parts = [self.ids.index(body[1 + 2 * k]) for k in range(n)]
        used = [body[2 + 2 * k] for k in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        bits = _Bits(data)
        if n > 1:
            order = _interleaved(self.sampling, self.rows, self.columns)
            targets = [order[c] for c in parts]
        else:  # alone, a component has only the blocks that its own size needs, row by row
            h, v = self.sampling[parts[0]]
            across, down = (-(-(-(-x * s // m)) // 8) for x, s, m in ((self.width, h, self.most[0]), (self.height, v, self.most[1])))
            targets = [(np.arange(down)[:, None] * self.columns * h + np.arange(across)).reshape(-1, 1)]
        arrays = [self.coefficients[c] for c in parts]
        if first == 0:
            if high:
                _dc_refine(bits, targets, arrays, low)
            else:
                _dc_first(bits, [tables[u >> 4] for u in used], targets, arrays, low)
        else:
            (_ac_refine if high else _ac_first)(bits, tables[0x10 | used[0] & 15], targets[0][:, 0], arrays[0], first, last, low)

    def rgb(self) -> np.ndarray:
        """Full-resolution RGB (height x width x 3, 8 bits)."""
        planes = []
        for c, q, (h, v) in zip(self.coefficients, self.quant, self.sampling):
            samples = c.astype(np.float32) @ (q.astype(np.float32)[:, None] * _COSINES) + 128
            plane = samples.reshape(self.rows * v, self.columns * h, 8, 8).transpose(0, 2, 1, 3).reshape(self.rows * v * 8, self.columns * h * 8)
            plane = np.clip(plane, 0, 255)
            plane = np.repeat(np.repeat(plane, self.most[1] // v, axis=0), self.most[0] // h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            planes = [planes[0]] * 3
        else:
            y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
            planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, plane in enumerate(planes):
            out[:, :, k] = np.clip(plane, 0, 255) + np.float32(0.501)  # rounds; halves go up, whatever the last digits
        return out

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        size = int(self.comment.split()[2])
        return (np.concatenate(self.coefficients).reshape(-1)[:size] - _OFFSET).astype(np.uint8).tobytes()


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def describe(rgb: np.ndarray) -> str:
    """Size and, for each channel, mean and spread from exact sums."""
    flat, n = rgb.reshape(-1, 3), rgb.shape[0] * rgb.shape[1]
    counts = [np.bincount(flat[:, k], minlength=256) for k in range(3)]
    levels = np.arange(256)
    total, square = np.array([c @ levels for c in counts]), np.array([c @ (levels * levels) for c in counts])
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{s / n:.2f}/{max(0.0, q / n - (s / n) ** 2) ** 0.5:.2f}" for s, q in zip(total.tolist(), square.tolist()))


class _Store:
    def __call__(self, batch) -> dict:
        data = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
        return {"doc_id": batch.column(0), "n_bytes": [len(x) for x in data], "media": pa.array([encode(padded(x), len(x)) for x in data], pa.binary())}


class _Load:
    def __call__(self, batch) -> dict:
        out: dict[str, list] = {"payload": [], "width": [], "height": [], "rgb": [], "error": []}
        for media in batch.column(1):
            row = dict.fromkeys(out)
            if media.is_valid:
                try:
                    picture = Picture(media.as_py())
                    row = {"payload": picture.payload(), "width": picture.width, "height": picture.height, "rgb": picture.rgb().tobytes(), "error": None}
                except (ValueError, IndexError, KeyError, AttributeError, TypeError, struct.error) as failure:  # cut short, or another kind of file
                    row["error"] = f"not a picture that this reads: {failure}"
            for name, value in row.items():
                out[name].append(value)
        return {"doc_id": batch.column(0), **out}


class _Digest:
    def __call__(self, batch) -> dict:
        rows: list[tuple] = []
        for text in batch.column(1):
            data = (text.as_py() or "").encode("utf-8", "replace")
            media = encode(padded(data), len(data))
            picture = Picture(media)
            back, rgb = picture.payload(), picture.rgb()
            rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(rgb), hashlib.sha256(rgb.tobytes()).hexdigest()))
        columns = zip(*rows)
        return {"doc_id": batch.column(0)} | dict(zip(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rgb_sha256"), map(list, columns)))


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t()) for n, t in columns.items()])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text (null: empty) as a progressive JPEG, row by row."""
    return map_batches(_texts(docs), _Store(), _schema(doc_id=T.LongType, n_bytes=T.LongType, media=T.BinaryType))


def load(media: DataFrame) -> DataFrame:
    """``doc_id, payload, width, height, rgb, error`` of files in ``doc_id, media``; rgb is row-major, three bytes a pixel.

    Null media gives a row of nulls, and a file that is cut short or of another kind one whose ``error`` says why.
    Repeated rows stay repeated, an empty table gives an empty result, further columns are ignored.
    """
    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media"))
    return map_batches(rows, _Load(), _schema(doc_id=T.LongType, payload=T.BinaryType, width=T.IntegerType, height=T.IntegerType, rgb=T.BinaryType, error=T.StringType))


def media_digests(docs: DataFrame) -> DataFrame:
    """Each row's text stored, read back and described; equal texts get equal values.

    ``rgb_sha256`` is the digest of the tensor that ``load`` stores as ``rgb``: height x width x 3 bytes, row-major.
    Null and empty texts are 64 zero bytes. Repeated rows stay repeated, an empty table gives an empty result,
    further columns are ignored.
    """
    out = _schema(doc_id=T.LongType, n_bytes=T.LongType, payload_bytes=T.LongType, payload_sha256=T.StringType, tail_crc32=T.LongType, media_bytes=T.LongType, media_sha256=T.StringType, feature=T.StringType, rgb_sha256=T.StringType)
    return map_batches(_texts(docs), _Digest(), out)
