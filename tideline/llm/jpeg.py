"""Media columns: progressive JPEG decoding in numpy, and a writer that stores bytes losslessly as coefficients.

The decoder follows ITU-T T.81: it accumulates spectral-selection and successive-approximation scans (DC and AC, first
and refining, with end-of-band runs and restart intervals) into coefficient arrays, then dequantises, inverse-transforms,
upsamples chroma and returns a full-resolution RGB tensor.

Entropy-coded data are decoded table by table, not bit by bit: for every bit position the symbol that would start
there is looked up at once, and only the chain of starts is followed. Where a table gives each symbol and its extra bits
the same total length, the starts are a plain range. Correction bits under an end-of-band run are applied at once.

The writer lays a payload out as 8x8 blocks of quantised coefficients (quantisation 1), one byte a coefficient, 4:2:0. A
byte b becomes the value +-(2 + b mod 128), never zero, so every scan's codes have one length. Any progressive decoder
reads the same coefficients, so the payload is kept exactly; the pictures are noise.

Defined results: null text is empty; a payload has at least one block; blocks beyond the payload hold byte 0; equal texts
give equal files; repeated rows stand for themselves; an empty table gives no rows; other columns are left out. Not
handled, with an error: sequential and arithmetic coding, 12-bit samples, more than four components.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, by_bytes, documents, table


def zigzag() -> np.ndarray:
    """Natural index of each position in zigzag order, by the rule of the diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
_k, _x = np.mgrid[0:8, 0:8]
COSINES = (np.where(_k == 0, 0.5**0.5, 1) * 0.5 * np.cos((2 * _x + 1) * _k * np.pi / 16)).astype(np.float32)  # COSINES[u, x]


@dataclass
class Component:
    ident: int
    h: int
    v: int
    tq: int
    across: int = 0  # blocks that hold samples
    down: int = 0
    wide: int = 0  # blocks with those that fill the last MCUs
    high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))  # zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]


NO_VALUE = -32768

# -- entropy-coded data ------------------------------------------------------------------------------------------------


class Huffman:
    """A table in the standard's form: number of codes of each length, then symbols."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.codes: dict[int, tuple[int, int]] = {}
        self.symbol, self.size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[symbols[k]] = (code, length)
                at = code << (16 - length)
                self.symbol[at : at + (1 << (16 - length))], self.size[at : at + (1 << (16 - length))] = symbols[k], length
                code, k = code + 1, k + 1
            code <<= 1
        self.counts, self.symbols = counts, symbols
        self.fixed = {dc: self.fixed_width(dc) for dc in (False, True)}

    def fixed_width(self, dc: bool) -> tuple[int, np.ndarray | None]:
        """Where every symbol and its extra bits have one total length and stand for one value: that length, and the value of each word."""
        stride = self.stride(dc)
        if not 1 <= stride <= 12 or (not dc and any(s >> 4 for s in self.symbols)):
            return 0, None
        word = np.arange(1 << stride) << (16 - stride)
        size = self.symbol[word].astype(np.int64)
        raw = (np.arange(1 << stride) & ((1 << size) - 1)).astype(np.int64)
        value = np.where((size > 0) & (raw < (1 << np.maximum(size, 1) - 1)), raw - (1 << size) + 1, raw)
        return stride, np.where(self.size[word] > 0, value, NO_VALUE).astype(np.int16)

    def extra(self, dc: bool) -> np.ndarray:
        """Extra bits of each symbol in the first scans: a value's, or those of a run of ended bands."""
        s = np.arange(256)
        return s if dc else np.where((s & 15) > 0, s & 15, np.where(s >> 4 < 15, s >> 4, 0))

    def stride(self, dc: bool) -> int:
        """The one total length of all symbols with their extra bits, or 0."""
        lengths = {self.codes[s][1] + int(self.extra(dc)[s]) for s in self.symbols}
        ended = not dc and any(s & 15 == 0 for s in self.symbols)
        return lengths.pop() if len(lengths) == 1 and not ended else 0


class Bits:
    """The bits of one entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8)
        self.n = 8 * len(data)

    def flags(self, start: int, n: int) -> np.ndarray:
        if start + n > self.n + 7:
            raise ValueError("the segment ends too early")
        first = start >> 3
        return np.unpackbits(self.data[first : (start + n + 7 >> 3) + 1])[start - 8 * first : start - 8 * first + n]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """16 bits from each position."""
        k = np.minimum(at >> 3, len(self.data) - 3)
        d = self.data
        w = (d[k].astype(np.uint32) << 16) | (d[k + 1].astype(np.uint32) << 8) | d[k + 2]
        return (w >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF

    def values(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The standard's signed values of ``size`` bits (15 at most) from each position."""
        raw = (self.windows(at) >> (16 - size).astype(np.uint32)).astype(np.int32)
        return np.where((size > 0) & (raw < (1 << np.maximum(size, 1) - 1)), raw - (1 << size) + 1, raw)

    def chain(self, table: Huffman, dc: bool) -> list[int]:
        """For each bit position, where the next symbol starts if one starts here."""
        at = np.arange(self.n)
        w = self.windows(at)
        return (at + np.where(table.size[w] > 0, table.size[w] + table.extra(dc)[table.symbol[w]], self.n + 1)).tolist()


def same_width(bits: Bits, table: Huffman, dc: bool, n: int) -> np.ndarray | None:
    """n values of a table with words of one length."""
    stride, value = table.fixed[dc]
    if not stride:
        return None
    if n * stride > bits.n:
        raise ValueError("the segment ends too early")
    word = bits.data[:n] if stride == 8 else bits.windows(np.arange(n) * stride) >> (16 - stride)
    out = value[word]
    if (out == NO_VALUE).any():
        raise ValueError("a code that no symbol has")
    return out


def ac_first(bits: Bits, table: Huffman, blocks: np.ndarray, ss: int, se: int, al: int, coef: np.ndarray) -> None:
    band, n = se - ss + 1, len(blocks)
    value = same_width(bits, table, False, n * band)
    if value is not None:
        if n == blocks[-1] - blocks[0] + 1:  # blocks rise, so they are a range
            np.left_shift(value.reshape(n, band), al, out=coef[blocks[0] : blocks[0] + n, ss : se + 1])
        else:
            coef[blocks[:, None], np.arange(ss, se + 1)] = value.reshape(n, band) << al
        return
    follow = bits.chain(table, False)
    symbols = table.symbol[bits.windows(np.arange(bits.n))]
    sizes = table.size[bits.windows(np.arange(bits.n))]
    rows, cols, starts, lengths = [], [], [], []
    p, block, k = 0, 0, ss
    while block < n:
        if p >= bits.n or sizes[p] == 0:
            raise ValueError("the segment ends too early")
        s = int(symbols[p])
        run, size = s >> 4, s & 15
        if size:
            k += run
            if k > se:
                raise ValueError("a run leaves its band")
            rows.append(block), cols.append(k), starts.append(p + int(sizes[p])), lengths.append(size)
            k += 1
        elif run == 15:
            k += 16
        else:
            q = p + int(sizes[p])
            block += (1 << run) + (int("".join(map(str, bits.flags(q, run))), 2) if run else 0)
            k = ss
        if k > se:
            block, k = block + 1, ss
        p = follow[p]
    if rows:
        coef[blocks[rows], cols] = bits.values(np.array(starts), np.array(lengths)) << al


def ac_refine(bits: Bits, table: Huffman, blocks: np.ndarray, ss: int, se: int, al: int, coef: np.ndarray) -> None:
    n, p, block, k, step = len(blocks), 0, 0, ss, 1 << al

    def correct(row: np.ndarray, cols: np.ndarray, start: int) -> int:
        bit = bits.flags(start, len(row)).astype(bool)
        row, cols = row[bit], cols[bit]
        old = coef[row, cols]
        coef[row, cols] = old + np.where(old > 0, step, -step)
        return start + len(bit)

    while block < n:
        w = int(bits.windows(np.array([p]))[0])
        if p >= bits.n or table.size[w] == 0:
            raise ValueError("the segment ends too early")
        p += int(table.size[w])
        run, size = int(table.symbol[w]) >> 4, int(table.symbol[w]) & 15
        if size == 0 and run < 15:  # this band and the next ones end: only correction bits are left, in order
            extra = int("".join(map(str, bits.flags(p, run))), 2) if run else 0
            p, many = p + run, (1 << run) + extra
            mine = blocks[block : block + many]
            if k == ss and len(mine) == mine[-1] - mine[0] + 1:
                part = coef[mine[0] : mine[0] + len(mine), ss : se + 1]
                if part.all():
                    bit = bits.flags(p, part.size).reshape(part.shape).astype(np.int16) * np.int16(step)
                    part += np.where(part < 0, -bit, bit)
                    p, block = p + part.size, block + many
                    continue
            first = blocks[block]
            cols = np.flatnonzero(coef[first, k : se + 1]) + k
            p = correct(np.full(len(cols), first), cols, p)
            rest = blocks[block + 1 : block + many]
            if len(rest):
                part = coef[rest, ss : se + 1]
                if part.all():
                    row, col = np.repeat(rest, se - ss + 1), np.tile(np.arange(ss, se + 1), len(rest))
                else:
                    i, col = np.nonzero(part)
                    row, col = rest[i], col + ss
                p = correct(row, col, p)
            block, k = block + many, ss
            continue
        here, value = blocks[block], 0
        if size:
            value, p = step if bits.flags(p, 1)[0] else -step, p + 1
        zeros = np.flatnonzero(coef[here, k : se + 1] == 0)
        stop = k + int(zeros[run]) if len(zeros) > run else se + 1
        if stop > se and size:
            raise ValueError("a run leaves its band")
        cols = np.flatnonzero(coef[here, k : min(stop, se + 1)]) + k
        p = correct(np.full(len(cols), here), cols, p)
        if size:
            coef[here, stop] = value
        k = stop + 1
        if k > se:
            block, k = block + 1, ss


def dc_first(bits: Bits, tables: list[Huffman], which: np.ndarray, n: int, al: int) -> np.ndarray:
    """Values before the point transform, per unit; which: the component of each unit of an MCU."""
    per = len(which)
    unit = np.resize(which, n)
    diff = same_width(bits, tables[0], True, n) if all(t is tables[0] for t in tables) else None
    if diff is None:
        follow = [bits.chain(t, True) for t in tables]
        at, p, order = np.empty(n, np.int64), 0, which.tolist()
        for i in range(n):
            if p >= bits.n:
                raise ValueError("the segment ends too early")
            at[i] = p
            p = follow[order[i % per]][p]
        w = bits.windows(at)
        size, symbol = np.empty(n, np.int64), np.empty(n, np.int64)
        for c, t in enumerate(tables):
            mine = unit == c
            size[mine], symbol[mine] = t.size[w[mine]], t.symbol[w[mine]]
        diff = bits.values(at + size, symbol)
    out = np.empty(n, np.int64)
    for c in range(len(tables)):
        out[unit == c] = np.cumsum(diff[unit == c])
    return out << al


@functools.lru_cache(512)
def order_of_units(comps: tuple[tuple[int, ...], ...], mcus: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component of each unit of an MCU, component and block of every unit of the scan), from (h, v, across, down, wide) of the
    scan's components; a scan of one component has no padding blocks."""
    if len(comps) == 1:
        _, _, across, down, wide = comps[0]
        r, k = np.divmod(np.arange(across * down), across)
        return np.zeros(1, np.int64), np.zeros(len(r), np.int64), r * wide + k
    which = np.concatenate([np.full(h * v, i) for i, (h, v, *_) in enumerate(comps)])
    my, mx = np.divmod(np.arange(mcus[0] * mcus[1]), mcus[0])
    cells = []
    for h, v, _, _, wide in comps:
        y, x = np.divmod(np.arange(h * v), h)
        cells.append((my[:, None] * v + y) * wide + mx[:, None] * h + x)
    return which, np.tile(which, len(my)), np.concatenate(cells, axis=1).ravel()


# -- files ---------------------------------------------------------------------------------------------------------------


def segments(data: bytes, start: int) -> tuple[list[bytes], int]:
    """The entropy-coded segments of a scan, unstuffed, and where the next marker is."""
    out, begin, p = [], start, start
    while True:
        p = data.find(b"\xff", p)
        if p < 0 or p + 1 >= len(data):
            raise ValueError("a scan has no end")
        if data[p + 1] == 0:
            p += 2
        elif 0xD0 <= data[p + 1] <= 0xD7:
            out.append(data[begin:p].replace(b"\xff\0", b"\xff"))
            begin = p = p + 2
        else:
            out.append(data[begin:p].replace(b"\xff\0", b"\xff"))
            return out, p


_tables: dict[bytes, list[tuple[int, Huffman]]] = {}


def huffman_segment(body: bytes) -> list[tuple[int, Huffman]]:
    if body not in _tables:
        if len(_tables) > 256:
            _tables.clear()
        found, p = [], 0
        while p < len(body):
            counts = list(body[p + 1 : p + 17])
            found.append((body[p], Huffman(counts, list(body[p + 17 : p + 17 + sum(counts)]))))
            p += 17 + sum(counts)
        _tables[body] = found
    return _tables[body]


def read(data: bytes) -> Image:
    """The coefficient arrays of a progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    p, quant, tables, image, interval = 2, {}, {}, None, 0
    while True:
        while data[p : p + 2] == b"\xff\xff":
            p += 1
        marker = data[p + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[p + 2 : p + 4], "big")
        body, p = data[p + 4 : p + 2 + size], p + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 2 if body[k] >> 4 else 1
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, k + 1).astype(np.int32)
                k += 1 + 64 * wide
        elif marker == 0xC4:
            tables |= dict(huffman_segment(body))
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            depth, height, width, many = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not 1 <= many <= 4:
                raise ValueError("only 8-bit samples and up to four components are handled")
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
            hm, vm = max(c.h for c in comps), max(c.v for c in comps)
            mcus = (-(-width // (8 * hm)), -(-height // (8 * vm)))
            for c in comps:
                c.across, c.down = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
                c.wide, c.high = mcus[0] * c.h, mcus[1] * c.v
                c.coef = np.zeros((c.wide * c.high, 64), np.int16)
            image = Image(width, height, comps, quant)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded files are handled")
        elif marker == 0xDA:
            by_id = {c.ident: c for c in image.components}
            chosen = [(by_id[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            ss, se, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            pieces, p = segments(data, p)
            one_scan(pieces, chosen, tables, mcus, interval, ss, se, ah, al)
    return image


def one_scan(pieces: list[bytes], chosen, tables, mcus, interval: int, ss: int, se: int, ah: int, al: int) -> None:
    comps = [c for c, _ in chosen]
    which, unit, block = order_of_units(tuple((c.h, c.v, c.across, c.down, c.wide) for c in comps), mcus)
    step = len(unit) if not interval else interval * len(which)
    for i, piece in enumerate(pieces):
        u, b, bits = unit[i * step : (i + 1) * step], block[i * step : (i + 1) * step], Bits(piece)
        if ss == 0:
            values = bits.flags(0, len(u)).astype(np.int16) << al if ah else dc_first(bits, [tables[t >> 4] for _, t in chosen], which, len(u), al)
            for k, c in enumerate(comps):
                mine = u == k
                if ah:
                    c.coef[b[mine], 0] |= values[mine]
                else:
                    c.coef[b[mine], 0] = values[mine]
        else:
            (ac_refine if ah else ac_first)(bits, tables[0x10 | (chosen[0][1] & 15)], b, ss, se, al, comps[0].coef)


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component before clipping, by the inverse transform of dequantised coefficients."""
    out = []
    for c in image.components:
        f = np.empty((len(c.coef), 64), np.float32)
        f[:, ZIGZAG] = c.coef if (image.quant[c.tq] == 1).all() else c.coef * image.quant[c.tq]
        g = f.reshape(-1, 8, 8)
        s = (COSINES.T @ g) @ COSINES
        out.append(s.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide) + 128)
    return out


def rgb(image: Image) -> np.ndarray:
    """height x width x 3, unsigned 8-bit: chroma repeated to full resolution, then the JFIF colour transform."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, s in zip(image.components, planes(image), strict=True):
        s = np.clip(s, 0, 255)
        if hm % c.h or vm % c.v:
            y = np.arange(image.height) * c.v // vm
            full.append(s[y][:, np.arange(image.width) * c.h // hm])
        else:
            s = s if (hm, vm) == (c.h, c.v) else s.repeat(vm // c.v, 0).repeat(hm // c.h, 1)
            full.append(s[: image.height, : image.width])
    if len(full) < 3:
        return np.repeat(np.rint(full[0]).astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0], out[..., 1], out[..., 2] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return np.rint(np.clip(out, 0, 255, out=out)).astype(np.uint8)


# -- writing -------------------------------------------------------------------------------------------------------------


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def by_length(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)], order


def magnitude_bits(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and extra bits of values."""
    size = np.zeros(value.shape, np.int64)
    size[value != 0] = np.floor(np.log2(np.abs(value[value != 0]))).astype(np.int64) + 1
    return size, np.where(value < 0, value + (1 << size) - 1, value)


DC_BITS, AC_BITS = 10, 8
#: Lengths that make code and extra bits DC_BITS and AC_BITS in all; and a plain code for end-of-band runs.
DC_TABLE = Huffman(*by_length({s: DC_BITS - s for s in range(9)}))
AC_TABLE = Huffman(*by_length({s: AC_BITS - s for s in range(1, 8)}))
EOB_TABLE = Huffman(*by_length({r << 4: 4 for r in range(15)}))
VALUE = np.where(np.arange(256) < 128, 2 + np.arange(256), -(2 + np.arange(256) - 128)).astype(np.int32)  # of a byte
BYTE = np.zeros(512, np.uint8)
BYTE[VALUE + 256] = np.arange(256)


def code_words(table: Huffman, values: np.ndarray) -> np.ndarray:
    size, extra = magnitude_bits(values)
    code = np.array([table.codes.get(s, (0, 0))[0] for s in range(16)])
    return (code[size] << size) | extra


HALF = np.where(VALUE > 0, VALUE >> 1, -((-VALUE) >> 1))  # a coefficient without its lowest bit
AC_WORD = code_words(AC_TABLE, HALF).astype(np.uint8)
DC_WORD = code_words(DC_TABLE, np.arange(-255, 256)).astype(">u2")
LOW_BIT = (np.abs(VALUE) & 1).astype(np.uint8)


def stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\0")


def eob_runs(n: int) -> list[int]:
    return [min(32767, n - k) for k in range(0, n, 32767)]


def frame(blocks: int) -> tuple[int, int]:
    """MCUs across and down that hold so many blocks, six in each."""
    mcus = -(-blocks // 6)
    across = max(math.isqrt(mcus), -(-mcus // 4095))
    return across, -(-mcus // across)


HEAD = b"\xff\xd8" + marker(0xDB, b"\0" + b"\1" * 64)


def huffman_body(kind: int, table: Huffman) -> bytes:
    return bytes([kind, *table.counts, *table.symbols])


TABLES = marker(0xC4, huffman_body(0, DC_TABLE) + huffman_body(0x10, AC_TABLE) + huffman_body(0x11, EOB_TABLE))


_units: dict[tuple[int, int], np.ndarray] = {}


def mcu_order(across: int, down: int) -> np.ndarray:
    """Row in the stacked blocks (Y, Cb, Cr) of every unit in MCU order."""
    key = (across, down)
    if key not in _units:
        if len(_units) > 512:
            _units.clear()
        m = across * down
        y, x = np.divmod(np.arange(m), across)
        luma = ((2 * y[:, None] + np.array([0, 0, 1, 1])) * (2 * across)) + 2 * x[:, None] + np.array([0, 1, 0, 1])
        _units[key] = np.concatenate((luma, 4 * m + np.arange(m)[:, None], 5 * m + np.arange(m)[:, None]), axis=1).ravel()
    return _units[key]


def write(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients hold the payload (a positive multiple of 64 bytes)."""
    n = len(payload) // 64
    across, down = frame(n)
    m = across * down
    data = np.zeros((6 * m, 64), np.uint8)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    comps = ((1, 0, 4 * m), (2, 4 * m, 5 * m), (3, 5 * m, 6 * m))
    out = [HEAD, marker(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), TABLES]
    order = mcu_order(across, down)
    dc = (VALUE[data[:, 0]] >> 1)[order]
    diff = np.empty(6 * m, np.int64)
    unit = dc.reshape(m, 6)
    luma = unit[:, :4].ravel()
    d = diff.reshape(m, 6)
    d[:, :4] = np.diff(luma, prepend=0).reshape(m, 4)
    d[:, 4], d[:, 5] = np.diff(unit[:, 4], prepend=0), np.diff(unit[:, 5], prepend=0)
    bits = np.unpackbits(DC_WORD[diff + 255].view(np.uint8).reshape(-1, 2), axis=1)[:, 6:].ravel()
    out += [marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])), stuffed(packed(bits))]
    for ident, a, b in comps:
        out += [marker(0xDA, bytes([1, ident, 0, 1, 63, 1])), stuffed(AC_WORD[data[a:b, 1:]].tobytes())]
    low = (VALUE[data[:, 0]] & 1)[order].astype(np.uint8)
    out += [marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), stuffed(packed(low))]
    for ident, a, b in comps:
        fix, parts, at = LOW_BIT[data[a:b, 1:]], [], 0
        for run in eob_runs(b - a):
            r = run.bit_length() - 1
            code, length = EOB_TABLE.codes[r << 4]
            parts += [np.array([int(c) for c in f"{code:0{length}b}" + (f"{run - (1 << r):0{r}b}" if r else "")], np.uint8), fix[at : at + run].ravel()]
            at += run
        out += [marker(0xDA, bytes([1, ident, 1, 1, 63, 0x10])), stuffed(packed(np.concatenate(parts)))]
    return b"".join([*out, b"\xff\xd9"])


def packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(fill, np.uint8))) if fill else bits).tobytes()


def payload_of(image: Image, blocks: int) -> bytes:
    """The bytes that ``write`` stored, from the coefficients."""
    stacked = np.concatenate([c.coef for c in image.components])[:blocks]
    return BYTE[stacked + 256].tobytes()


def feature(image: Image, pixels: np.ndarray) -> str:
    """Size, mean of each colour, and checksum of the RGB tensor."""
    mean = [int(pixels[..., c].sum(dtype=np.int64)) for c in range(3)]
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{mean[0]}:{mean[1]}:{mean[2]}:{zlib.crc32(pixels):08x}"


BATCH_BYTES = 2 << 20  # of texts or files that are worked on together


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media: every whole text as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "text", 128, BATCH_BYTES):
                raw = part["text"].cast(pa.binary()).to_pylist()
                media = [write(padded(x)) for x in raw]
                yield batch(doc_id=part["doc_id"], n_bytes=pa.array([len(x) for x in raw], pa.int64()), payload_bytes=pa.array([len(padded(x)) for x in raw], pa.int64()), media=pa.array(media, pa.binary()))

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, media binary")


def decode(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Decodes the media column; with ``tensors`` the RGB tensor and its height and width are kept as columns."""
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "media", 128, BATCH_BYTES):
                yield decoded(part)

    def decoded(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, size in zip(b["media"].to_pylist(), b["payload_bytes"].to_pylist(), strict=True):
            image = read(data)
            pixels = rgb(image)
            payload = payload_of(image, size // 64)
            rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(image, pixels), pixels if tensors else None, len(payload)))
        sha, tail, n, media_sha, feat, pix, length = zip(*rows, strict=True) if rows else [()] * 7
        out = {"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "payload_bytes": pa.array(length, pa.int64()), "payload_sha256": pa.array(sha, pa.string()), "tail_crc32": pa.array(tail, pa.int64()), "media_bytes": pa.array(n, pa.int64()), "media_sha256": pa.array(media_sha, pa.string()), "feature": pa.array(feat, pa.string())}
        if tensors:
            out |= {"height": pa.array([x.shape[0] for x in pix], pa.int32()), "width": pa.array([x.shape[1] for x in pix], pa.int32()), "rgb": pa.array([x.tobytes() for x in pix], pa.binary())}
        return batch(**out)

    return media.mapInArrow(run, columns + (", height int, width int, rgb binary" if tensors else ""))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the RGB tensor of each text's image with its height and width."""
    return decode(store(table(spark, sf_dir, "documents")), tensors=True)
