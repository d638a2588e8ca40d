"""Progressive JPEG columns: lossless storage of bytes as coefficients, and decoding to full-resolution RGB tensors.

`decode` reads any progressive file of 8-bit samples with Huffman coding: it accumulates the scans of spectral selection and
successive approximation into coefficient arrays, dequantises, inverse-transforms by one matrix product in numpy,
upsamples the chroma by repetition and converts to RGB.

`encode` stores a payload in the format's unit, the quantised coefficient, one for each byte, in a three-component file with 2x2
chroma subsampling. A byte b is the coefficient b - 129 below 128 and b - 126 from there, so no magnitude is below 2:
after the first approximation (one bit left out) no coefficient is zero and there are no runs. The Huffman codes are chosen
so that code and magnitude bits of a coefficient take 8 bits together (9 for the differences of the DC terms), and in the
refinement scans each coefficient is one bit. So files of this kind are read and written by lookups of whole tokens; in all
others the codes are found by looking up what follows each bit of a stretch and following the chain (first scans), or code by
code with the corrections left to numpy (refinement). Short or odd data go symbol by symbol.

Cases: a null text is an empty one; a text of any length is one file, of up to 65,535 rows of blocks; null ids are kept as they are; repeated rows give
equal files; other columns don't matter, whatever their names; an empty payload is one unit of padding; padding beyond the payload's last
unit is of 255s and is cut by the length kept in a comment segment; equal texts give equal files; an empty table gives an
empty result; a file that is no progressive JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

UNIT = 576
#: Bytes of output that a batch gathers before it is passed on.
GATHERED = 8 << 20
#: Bytes of a scan whose bits are looked up at once.
STRETCH = 1 << 15


def _zigzag() -> np.ndarray:
    """Natural positions (8 * row + column) in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


@cache
def _basis() -> np.ndarray:
    """(64, 64): coefficients in zigzag order to samples in row order."""
    k = np.arange(8)
    one = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.ascontiguousarray(both[ZIGZAG], np.float32)


# -- Huffman tables --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Huffman:
    counts: tuple[int, ...]  # codes of 1 to 16 bits
    symbols: bytes

    def codes(self) -> Iterator[tuple[int, int, int]]:
        """(symbol, code, bits)."""
        code = k = 0
        for bits, n in enumerate(self.counts, 1):
            for _ in range(n):
                yield self.symbols[k], code, bits
                code, k = code + 1, k + 1
            code <<= 1

    def lookup(self) -> dict[tuple[int, int], int]:
        return {(bits, code): symbol for symbol, code, bits in self.codes()}


#: DC differences: 9 - s bits for size s, so that every difference takes 9. AC: 8 - s bits for size s. Refinement: 4 bits for each run of blocks.
DC = Huffman((1,) * 8 + (1,) + (0,) * 7, bytes([8, 7, 6, 5, 4, 3, 2, 1, 0]))
AC = Huffman((1,) * 8 + (0,) * 8, bytes([7, 6, 5, 4, 3, 2, 1, 0]))
RUNS = Huffman((0, 0, 0, 15) + (0,) * 12, bytes(range(0, 0xF0, 0x10)))


def _tokens(table: Huffman, width: int, least: int, most: int) -> np.ndarray:
    """Code and magnitude bits of each value from least to most; -1 where they don't take `width` bits."""
    code = {s: (c, bits) for s, c, bits in table.codes()}
    out = np.full(most - least + 1, -1, np.int64)
    for v in range(least, most + 1):
        size = abs(v).bit_length()
        if size in code and code[size][1] + size == width:
            out[v - least] = code[size][0] << size | (v if v >= 0 else v + (1 << size) - 1)
    return out


def _back(tokens: np.ndarray, width: int, least: int) -> np.ndarray:
    out = np.full(1 << width, 1 << 20, np.int32)
    out[tokens[tokens >= 0]] = np.flatnonzero(tokens >= 0) + least
    return out


_B = np.arange(256)
_COEFFICIENT = np.where(_B < 128, _B - 129, _B - 126).astype(np.int32)
_FIRST = np.sign(_COEFFICIENT) * (np.abs(_COEFFICIENT) >> 1)
_AC_TOKENS, _DC_TOKENS = _tokens(AC, 8, -64, 64), _tokens(DC, 9, -255, 255)
_AC_BACK, _DC_BACK = _back(_AC_TOKENS, 8, -64), _back(_DC_TOKENS, 9, -255)
_AC_OF_BYTE = _AC_TOKENS[_FIRST + 64].astype(np.uint8)
_LOW_OF_BYTE = (np.abs(_COEFFICIENT) & 1).astype(np.uint8)
_DC_FIRST, _DC_LOW = _COEFFICIENT >> 1, (_COEFFICIENT & 1).astype(np.uint8)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).reshape(-1)


def _stream(bits: np.ndarray) -> bytes:
    """Bits as an entropy-coded segment: padded by ones, a zero byte after each 255."""
    full = np.ones(-(-len(bits) // 8) * 8, np.uint8)
    full[: len(bits)] = bits
    return np.packbits(full).tobytes().replace(b"\xff", b"\xff\x00")


# -- writing ---------------------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _table(kind: int, at: int, table: Huffman) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | at, *table.counts]) + table.symbols)


def _scan(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *[x for c, d, a in parts for x in (c, d << 4 | a)], first, last, high << 4 | low]))


def _mcu_order(rows: int, cols: int) -> np.ndarray:
    """Raster numbers of the luma blocks in the order of their 2x2 units, (units, 4)."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    top = 4 * cols * r + 2 * c
    return np.stack([top, top + 1, top + 2 * cols, top + 2 * cols + 1], 1)


_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
_TABLES = _table(0, 0, DC) + _table(1, 0, AC) + _table(1, 1, RUNS)


def _correction(low: np.ndarray, blocks: int) -> bytes:
    """A refinement scan in which every coefficient has been met: runs of blocks and a bit for each coefficient."""
    parts, at = [], 0
    while at < blocks:
        run = min(32767, blocks - at)
        n = run.bit_length() - 1
        parts += [_bits(np.array([n]), 4), _bits(np.array([run - (1 << n)]), n), low[at : at + run].reshape(-1)]
        at += run
    return _stream(np.concatenate(parts))


def encode(payload: bytes) -> bytes:
    """A progressive file whose coefficients are the payload's bytes; luma blocks first, then both chroma planes."""
    units = max(1, -(-len(payload) // 384))
    cols = int(np.ceil(np.sqrt(units)))
    rows = -(-units // cols)
    data = np.full(rows * cols * 384, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = rows * cols
    blocks = data.reshape(-1, 64)
    planes = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    order = _mcu_order(rows, cols)
    frame = _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out = [_HEAD, _segment(0xFE, b"payload" + struct.pack(">Q", len(payload))), frame, _TABLES]

    dc = [_DC_FIRST[p[:, 0]] for p in planes]
    steps = np.empty((n, 6), np.int64)
    luma = dc[0][order].reshape(-1)
    steps[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    steps[:, 4], steps[:, 5] = np.diff(dc[1], prepend=0), np.diff(dc[2], prepend=0)
    out += [_scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 1), _stream(_bits(_DC_TOKENS[steps.reshape(-1) + 255], 9))]
    for c, first, last in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):  # no token is a byte 255: nothing to stuff
        out += [_scan([(c + 1, 0, 0)], first, last, 0, 1), _AC_OF_BYTE[planes[c][:, first : last + 1]].tobytes()]
    low = np.empty((n, 6), np.uint8)
    low[:, :4], low[:, 4], low[:, 5] = _DC_LOW[planes[0][:, 0]][order], _DC_LOW[planes[1][:, 0]], _DC_LOW[planes[2][:, 0]]
    out += [_scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 1, 0), _stream(low.reshape(-1))]
    for c in range(3):
        out += [_scan([(c + 1, 0, 1)], 1, 63, 1, 0), _correction(_LOW_OF_BYTE[planes[c][:, 1:]], len(planes[c]))]
    return b"".join([*out, b"\xff\xd9"])


# -- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row of the component, and rows, as non-interleaved scans have them
    tall: int = 0
    stride: int = 0  # blocks in a row of the padded plane
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    height: int
    width: int
    parts: list[Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""


class _Reader:
    """Bits of an entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        if self.at >= len(self.bits):
            return 0
        self.at += 1
        return self.bits[self.at - 1]

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")


def _interleaved(parts: list[Component], rows: int, cols: int) -> np.ndarray:
    """For a scan of several components: (part, block) in the order of the scan."""
    out = []
    r, c = np.divmod(np.arange(rows * cols), cols)
    for k, p in enumerate(parts):
        for y in range(p.v):
            for x in range(p.h):
                out.append(np.stack([np.full(rows * cols, k), (r * p.v + y) * p.stride + c * p.h + x], 1))
    return np.stack(out, 1).reshape(-1, 2)


def _slow_scan(data: bytes, parts: list[Component], order: np.ndarray, dc: list, ac: dict | None, band: tuple[int, int], high: int, low: int) -> None:
    """One segment, one symbol after another: what short or odd data need, and what the tables are tested against."""
    first, last = band
    reader, run, predicted = _Reader(data), 0, [0] * len(parts)
    for k, b in order.tolist():
        block = parts[k].blocks[b]
        if first == 0:
            if high:
                block[0] |= reader.bit() << low
            else:
                predicted[k] += reader.signed(reader.symbol(dc[k]))
                block[0] = predicted[k] << low
            continue
        if not high:
            if run:
                run -= 1
                continue
            z = first
            while z <= last:
                rs = reader.symbol(ac)
                r, s = rs >> 4, rs & 15
                if s:
                    z += r
                    block[z] = reader.signed(s) * (1 << low)
                    z += 1
                elif r == 15:
                    z += 16
                else:
                    run = (1 << r) + reader.take(r) - 1
                    break
            continue
        z = first
        if not run:
            while z <= last:
                rs = reader.symbol(ac)
                r, s = rs >> 4, rs & 15
                fresh = 0
                if s:
                    fresh = (1 if reader.bit() else -1) << low
                elif r < 15:
                    run = (1 << r) + reader.take(r)
                    break
                while z <= last:
                    if block[z]:
                        if reader.bit():
                            block[z] += (1 << low) if block[z] > 0 else -(1 << low)
                    elif r == 0:
                        if fresh:
                            block[z] = fresh
                        z += 1
                        break
                    else:
                        r -= 1
                    z += 1
        if run:
            while z <= last:
                if block[z] and reader.bit():
                    block[z] += (1 << low) if block[z] > 0 else -(1 << low)
                z += 1
            run -= 1


@cache
def _ahead(table: Huffman, dc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value of the next 16 bits: symbol, bits of its code, and bits with the value after it; 0 bits where no code fits."""
    symbols, bits, span = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for symbol, code, n in table.codes():
        r, s = symbol >> 4, symbol & 15
        here = slice(code << (16 - n), (code + 1) << (16 - n))
        symbols[here] = symbol
        if symbol < 16 or not dc:
            bits[here], span[here] = n, n + (s or (r if r < 15 else 0))
    return symbols, bits, span


def _triples(data: bytes, start: int, stop: int) -> np.ndarray:
    """Three bytes from each place as one number, zeros beyond the end."""
    raw = np.zeros(stop - start + 2, np.uint32)
    part = np.frombuffer(data, np.uint8)[start : stop + 2]
    raw[: len(part)] = part
    return raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]


def _chain(jump: np.ndarray, at: int, limit: int) -> np.ndarray:
    """The places below limit that jumps lead to, from `at` on: every 16th by a walk, those between from it."""
    far = jump
    for _ in range(4):
        far = far[far]
    heads, view = [], memoryview(far)
    while at < limit:
        heads.append(at)
        at = view[at]
    places = [np.array(heads, np.intp)]
    for _ in range(15):
        places.append(jump[places[-1]])
    places = np.stack(places, 1).reshape(-1)
    return places[places < limit]


def _symbols(data: bytes, slots: list[Huffman], dc: bool) -> tuple[np.ndarray, np.ndarray]:
    """(units, slots) of symbols, and of the values after them, as far as codes and data go. slots: the tables of a unit, in their turn.

    Where the next code begins depends on the place alone, so its place is looked up for every bit of a stretch at once, and the chain of units followed.
    """
    tables = {id(t): _ahead(t, dc) for t in slots}
    total, at, out = 8 * len(data), 0, []
    while at < total:
        start = at // 8
        stop = min(start + STRETCH, len(data))
        w = (_triples(data, start, stop + 4 * len(slots) + 4)[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).reshape(-1)
        n, here = len(w), np.arange(len(w))
        nexts = {}
        for k, (_, _, span) in tables.items():
            wide = span[w]
            nexts[k] = np.append(np.where(wide, np.minimum(here + wide, n), n), n)
        jump = nexts[id(slots[0])]
        for t in slots[1:]:
            jump = nexts[id(t)][jump]
        p = _chain(jump, at - 8 * start, 8 * (stop - start))
        ends = jump[p] + 8 * start
        good = int(np.argmax(bad)) if (bad := (ends > total) | (jump[p] == n)).any() else len(p)
        p = p[:good]
        symbol, value = np.empty((good, len(slots)), np.uint8), np.empty((good, len(slots)), np.int32)
        for k, t in enumerate(slots):
            codes, bits, span = tables[id(t)]
            x = w[p]
            symbol[:, k] = codes[x]
            value[:, k] = w[np.minimum(p + bits[x], n - 1)] >> (16 - (span[x] - bits[x])).astype(np.uint32)
            p = nexts[id(t)][p]
        out.append((symbol, value))
        if good < len(ends):
            break
        at = int(ends[-1])
    return np.concatenate([np.empty((0, len(slots)), np.uint8), *(x for x, _ in out)]), np.concatenate([np.empty((0, len(slots)), np.int32), *(x for _, x in out)])


def _signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    one = np.int32(1) << size.astype(np.int32)
    return np.where(value >= one >> 1, value, value - one + 1)


def _segment_scan(data: bytes, parts: list[Component], order: np.ndarray, dc: list[Huffman | None], ac: Huffman | None, band: tuple[int, int], high: int, low: int, per_unit: int) -> bool:
    """One segment of any scan by tables; False: it is short or odd, and nothing was done."""
    first, last = band
    wide, n = last - first + 1, len(order)
    if first == 0:
        if high:
            steps = np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(np.int32) << low
        else:
            slots = [dc[k] for k in order[:per_unit, 0]]
            if None in slots:
                return False
            size, value = _symbols(data, slots, True)
            steps = _signed(value, size).reshape(-1)[:n]
        if len(steps) < n:
            return False
        for k, p in enumerate(parts):
            mine = order[:, 0] == k
            if high:
                p.blocks[order[mine, 1], 0] |= steps[mine]
            else:
                p.blocks[order[mine, 1], 0] = np.cumsum(steps[mine]) << low
        return True
    if ac is None:
        return False
    p, at = parts[0], order[:, 1]
    if high:
        return _refine(data, p, at, ac, first, last, low)
    symbol, value = (x[:, 0] for x in _symbols(data, [ac], False))
    r, s = symbol >> 4, symbol & 15
    end = (s == 0) & (r < 15)
    passed = np.where(end, 0, np.where(s > 0, r.astype(np.int32) + 1, 16))
    gone = passed.cumsum()
    cuts = np.flatnonzero(end)
    base = np.append(0, gone[cuts])  # coefficients passed before each stretch between ends of blocks
    begin = np.append(0, (np.diff(base) // wide + (1 << r[cuts].astype(np.int64)) + value[cuts]).cumsum())
    if begin[-1] + ((gone[-1] if len(gone) else 0) - base[-1]) // wide < n:
        return False
    stretch = end.cumsum() - end
    inside = gone - base[stretch]
    block = begin[stretch] + (inside - 1) // wide
    mine = ~end & (block < n)
    if ((inside - passed)[mine] // wide != (inside[mine] - 1) // wide).any():
        return False
    mine &= s > 0
    p.blocks[at[block[mine]], first + (inside[mine] - 1) % wide] = _signed(value[mine], s[mine]) * (1 << low)
    return True


def _refine(data: bytes, part: Component, at: np.ndarray, table: Huffman, first: int, last: int, low: int) -> bool:
    """A refinement scan: code by code, but corrections, which are one bit for each coefficient known before, in their order, only as ranges of bits."""
    codes, bits, _ = map(memoryview, _ahead(table, False))
    wide, n, total = last - first + 1, len(at), 8 * len(data)
    view = memoryview(_triples(data, 0, len(data) + 8))
    now = part.blocks[at, first : last + 1]
    empty = now == 0
    zeros = memoryview(np.flatnonzero(empty) % wide)
    starts = np.append(0, empty.sum(1).cumsum()).tolist()
    known, flat = np.flatnonzero(~empty), now.reshape(-1)
    froms, counts, fresh, signs = [], [], [], []
    b = pos = 0
    while b < n:
        z, end, k = starts[b], starts[b + 1], 0
        while k < wide:
            if pos >= total:
                return False
            ahead = view[pos >> 3] >> (8 - (pos & 7)) & 0xFFFF
            if not bits[ahead]:
                return False
            pos += bits[ahead]
            r, s = codes[ahead] >> 4, codes[ahead] & 15
            if s or r == 15:
                sign = pos
                pos += s > 0
                z += r
                if z < end:
                    to = zeros[z]
                    z += 1
                    more = to - k - r
                    if s:
                        fresh.append(b * wide + to)
                        signs.append(sign)
                    k = to + 1
                else:
                    more, k = wide - k - (end - z + r), wide
            else:
                run = (1 << r) + ((view[pos >> 3] >> (8 - (pos & 7)) & 0xFFFF) >> (16 - r))
                pos += r
                upto = min(b + run, n)
                more = (upto - b) * wide - k - (starts[upto] - z)
                b, k = upto - 1, wide
            if more:
                froms.append(pos)
                counts.append(more)
                pos += more
        b += 1
    if pos > total:
        return False
    stream, counts = np.unpackbits(np.frombuffer(data, np.uint8)), np.array(counts, np.int64)
    places = np.repeat(np.array(froms, np.int64) - counts.cumsum() + counts, counts) + np.arange(len(known))
    added = stream[places].astype(np.int32) << low
    flat[known] += np.where(flat[known] > 0, added, -added)
    flat[fresh] = np.where(stream[signs], 1, -1) * (1 << low)
    part.blocks[at, first : last + 1] = now
    return True


def _fast_scan(data: bytes, parts: list[Component], order: np.ndarray, dc: list[Huffman | None], ac: Huffman | None, band: tuple[int, int], high: int, low: int) -> bool:
    """A whole scan by table lookups, where its tables and its content allow; False: nothing was done."""
    first, last = band
    if first == 0:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        if high:
            if len(bits) < len(order):
                return False
            bits = bits[: len(order)].astype(np.int32) << low
        else:
            if any(t != DC for t in dc) or len(bits) < 9 * len(order):
                return False
            tokens = bits[: 9 * len(order)].reshape(-1, 9) @ (1 << np.arange(8, -1, -1))
            bits = _DC_BACK[tokens]
            if (bits > 1 << 19).any():
                return False
        for k, p in enumerate(parts):
            mine = slice(None) if len(parts) == 1 else order[:, 0] == k
            if high:
                p.blocks[order[mine, 1], 0] |= bits[mine]
            else:
                p.blocks[order[mine, 1], 0] = np.cumsum(bits[mine]) << low
        return True
    p, at = parts[0], order[:, 1]
    straight = len(at) == len(p.blocks) and p.wide == p.stride
    wide = last - first + 1
    if not high:
        if ac != AC or len(data) != len(at) * wide:
            return False
        values = _AC_BACK[np.frombuffer(data, np.uint8)]
        if (values > 1 << 19).any():
            return False
        p.blocks[slice(None) if straight else at, first : last + 1] = (values << low).reshape(-1, wide)
        return True
    if ac != RUNS:
        return False
    now = p.blocks[:, first : last + 1] if straight else p.blocks[at, first : last + 1]
    if (now == 0).any():
        return False
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    added, done, b = np.empty((len(at), wide), np.int32), 0, 0
    weights = 1 << np.arange(15)
    while done < len(at):
        n = int(bits[b : b + 4] @ weights[3::-1]) if b + 4 <= len(bits) else 15
        if n == 15:
            return False
        b += 4
        run = (1 << n) + (int(bits[b : b + n] @ weights[:n][::-1]) if n else 0)
        b += n
        if done + run > len(at) or b + run * wide > len(bits):
            return False
        added[done : done + run] = bits[b : b + run * wide].reshape(run, wide)
        b, done = b + run * wide, done + run
    p.blocks[slice(None) if straight else at, first : last + 1] = now + np.where(now > 0, added, -added) * (1 << low)
    return True


def read(data: bytes, fast: bool = True) -> Image:
    """The coefficients of a progressive file, all scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, tables, huffman, restart = 2, None, {}, {}, 0
    comment = b""
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xFE:
            comment = body
        elif mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                tables[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = Huffman(tuple(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if bits != 8 or n not in (1, 3) or not height or not width:
                raise ValueError("only 8-bit files of one or three components")
            hm, vm = max(p.h for p in parts), max(p.v for p in parts)
            rows, cols = -(-height // (8 * vm)), -(-width // (8 * hm))
            for p in parts:
                p.wide, p.tall = -(-(-(-width * p.h // hm)) // 8), -(-(-(-height * p.v // vm)) // 8)
                p.stride = cols * p.h
                p.blocks = np.zeros((rows * p.v * p.stride, 64), np.int32)
            image = Image(height, width, parts, tables)
        elif mark in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive file with Huffman coding")
        elif mark == 0xDA:
            if image is None:
                raise ValueError("a scan without a frame")
            n = body[0]
            by_id = {p.id: p for p in image.parts}
            parts = [by_id[body[1 + 2 * k]] for k in range(n)]
            picks = [body[2 + 2 * k] for k in range(n)]
            band, high, low = (body[1 + 2 * n], body[2 + 2 * n]), body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            raw, at = data[at:end], end
            if n > 1:
                order = _interleaved(parts, rows, cols)
                per_unit = sum(p.h * p.v for p in parts)
            else:
                p = parts[0]
                y, x = np.divmod(np.arange(p.wide * p.tall), p.wide)
                order, per_unit = np.stack([np.zeros(len(x), np.int64), y * p.stride + x], 1), 1
            ac = huffman.get((1, picks[0] & 15)) if band[0] else None
            dc = [huffman.get((0, x >> 4)) for x in picks] if not band[0] and not high else [None] * n
            if fast and not restart and _fast_scan(raw.replace(b"\xff\x00", b"\xff"), parts, order, dc, ac, band, high, low):
                continue
            pieces, start, seek = [], 0, 0
            while (k := raw.find(b"\xff", seek)) >= 0 and k + 1 < len(raw):
                if raw[k + 1]:
                    pieces.append(raw[start:k])
                    start = k + 2
                seek = k + 2
            pieces = [x.replace(b"\xff\x00", b"\xff") for x in [*pieces, raw[start:]]]
            step = restart * per_unit if restart else len(order)
            for k, piece in enumerate(pieces):
                units = order[k * step : (k + 1) * step]
                if len(units) and not (fast and _segment_scan(piece, parts, units, dc, ac, band, high, low, per_unit)):
                    _slow_scan(piece, parts, units, [t and t.lookup() for t in dc], ac and ac.lookup(), band, high, low)
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def tensor(image: Image) -> np.ndarray:
    """(height, width, 3) of bytes: RGB at full resolution."""
    hm, vm = max(p.h for p in image.parts), max(p.v for p in image.parts)
    planes = []
    for p in image.parts:
        table = image.tables[p.table]
        scaled = p.blocks.astype(np.float32) if (table == 1).all() else p.blocks * table
        samples = np.clip(np.rint(scaled @ _basis() + 128), 0, 255).astype(np.float32)
        plane = samples.reshape(-1, p.stride, 8, 8).swapaxes(1, 2).reshape(-1, p.stride * 8)
        if p.v < vm:
            plane = plane.repeat(vm // p.v, 0)
        if p.h < hm:
            plane = plane.repeat(hm // p.h, 1)
        planes.append(plane[: image.height, : image.width])
    out = np.empty((image.height, image.width, 3), np.uint8)
    if len(planes) == 1:
        out[:] = planes[0][..., None].astype(np.uint8)
        return out
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[..., k] = np.clip(np.rint(x), 0, 255)
    return out


def payload(image: Image) -> bytes:
    """The bytes that encode() stored."""
    if not image.comment.startswith(b"payload"):
        raise ValueError("no payload")
    flat = np.concatenate([p.blocks.reshape(-1) for p in image.parts])
    data = np.where(flat < 0, flat + 129, flat + 126).astype(np.uint8)
    return data[: struct.unpack(">Q", image.comment[7:15])[0]].tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, and mean and root mean square of each channel in thousandths, from whole-number sums."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    levels = np.arange(256)
    counts = [np.bincount(flat[:, k], minlength=256) for k in range(3)]
    sums, squares = [int(c @ levels) for c in counts], [int(c @ levels**2) for c in counts]
    means = ",".join(str(1000 * s // n) for s in sums)
    return f"{rgb.shape[0]}x{rgb.shape[1]};{means};" + ",".join(str(1000 * s // n) for s in squares)


# -- columns ---------------------------------------------------------------------------------------------------------


def _flushed(rows: Iterator[tuple[tuple, int]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= GATHERED or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a progressive file; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                texts = text_of(batch.column(1)).cast(pa.large_binary())
                for k, i in enumerate(batch.column(0)):
                    raw = texts[k].as_py()
                    media = encode(padded(raw))
                    yield (i.as_py(), len(raw), media), len(media)

        yield from _flushed(rows(), [id_col, "n_bytes", "media"], [None, pa.int64(), pa.binary()])

    kind_of = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind_of}, n_bytes bigint, media binary")


def decode_media(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, height, width, rgb): full-resolution tensors of any progressive files, rows of RGB bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for i, m in zip(batch.column(0), batch.column(1), strict=True):
                    rgb = tensor(read(m.as_py())) if m.is_valid else None
                    yield (i.as_py(), rgb.shape[0], rgb.shape[1], rgb.tobytes()) if rgb is not None else (i.as_py(), None, None, None), rgb.size if rgb is not None else 0

        yield from _flushed(rows(), [id_col, "height", "width", "rgb"], [None, pa.int32(), pa.int32(), pa.binary()])

    kind_of = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")).mapInArrow(run, f"`{id_col}` {kind_of}, height int, width int, rgb binary")


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of store_texts(), from the stored files alone: the payload from the coefficients, the feature from the decoded tensor."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for i, n, m in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    data = m.as_py()
                    image = read(data)
                    own = payload(image)
                    row = (i.as_py(), n.as_py(), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(tensor(image)))
                    yield row, 400

        yield from _flushed(rows(), names, types)

    kind_of = stored.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind_of}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)
