"""Media columns: progressive JPEG images in binary columns, decoded to full-resolution RGB tensors in numpy.

``decode`` reads any Huffman-coded 8-bit progressive JPEG of one or three components (spectral selection and
successive approximation, restart intervals, sides of any length, any chroma sampling). The entropy-coded segments of
all images of a batch advance together, one symbol (or, in refinement scans, one coefficient) a step, into
coefficient arrays; these are inverse-transformed as one matrix product of integers (exact in float64, so
equal images give equal pixels), chroma is upsampled by repetition, and RGB comes from integer arithmetic.

``encode`` stores bytes losslessly in the format's own unit, the quantised coefficient: a byte b becomes the
coefficient b (128 and up) or b - 255, a block takes 64 bytes, and a macro block of 4:2:0 sampling six
blocks. Quantisers are 1. Scans: DC without its low bit, AC 1-5 and 6-63 without their low bits, then the
refinements of DC and AC. Unused blocks of the last row hold byte 32.

Defined results: null counts as the empty text; payloads are never empty (at least 192 bytes); equal texts
give equal bytes, tensors and features; repeated rows repeat; an empty table stays empty. Bytes that are no such
JPEG (null, empty, cut off, another format) give a null tensor and a reason. The longest payload
is what one image holds (4095 x 4095 macro blocks, 6.4 GB); one image must fit a worker's memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, slices

UNIT, FILL = 192, 32
#: Macro blocks (in one-component scans: blocks) between restart markers.
RESTART = 4


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Pixels of each zigzag coefficient, times 4096, in integers."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(full[zigzag()] * 4096)


# ---------------------------------------------------------------- writing


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, size: int, symbols: list[int]) -> bytes:
    """A Huffman table whose codes all have ``size`` bits."""
    return _marker(0xC4, bytes([kind, *(len(symbols) if i == size else 0 for i in range(1, 17)), *symbols]))


#: DC sizes in 4 bits; the AC symbol "no zeros, 7 bits" in 1 bit; end-of-block runs of 1, 2-3 and 4-7 in 2 bits.
_DC, _FIRST, _RUNS = _table(0x00, 4, list(range(12))), _table(0x10, 1, [0x07]), _table(0x11, 2, [0x00, 0x10, 0x20])
_HEAD = b"\xff\xd8" + _marker(0xDB, bytes([0] + [1] * 64))


def _scan(components: list[tuple[int, int]], low: int, high: int, was: int, shift: int) -> bytes:
    return _marker(0xDA, bytes([len(components), *(x for c in components for x in c), low, high, was << 4 | shift]))


_ALL = [(1, 0), (2, 0), (3, 0)]
_SCANS = [
    _scan(_ALL, 0, 0, 0, 1),
    *(_scan([(c, 0)], a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in (1, 2, 3)),
    _scan(_ALL, 0, 0, 1, 0),
    *(_scan([(c, 0x01)], 1, 63, 1, 0) for c in (1, 2, 3)),
]


def geometry(payload: int) -> tuple[int, int]:
    """Rows and columns of macro blocks for a payload of so many bytes."""
    n = -(-payload // 384)
    cols = isqrt(n - 1) + 1
    return -(-n // cols), cols


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each image dealt into segments: unit numbers (segments, RESTART), -1 beyond the end; the image; whether it is the image's last."""
    n = -(-counts // RESTART)
    image = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    local = nth[:, None] * RESTART + np.arange(RESTART)
    first = (np.cumsum(counts) - counts)[image]
    grid = np.where(local < counts[image][:, None], local + first[:, None], -1)
    return grid, image, nth == n[image] - 1


def _stream(rows: np.ndarray, sizes: np.ndarray, image: np.ndarray, last: np.ndarray, images: int) -> list[bytes]:
    """Entropy-coded data by image: the first ``sizes`` bytes of each row, stuffed, with restart markers between rows."""
    n, width = rows.shape
    out = np.zeros((n, width + 2), np.uint8)
    out[:, :width] = rows
    live = np.zeros((n, width + 2), bool)
    live[:, :width] = np.arange(width) < sizes[:, None]
    nth = np.arange(n) - np.searchsorted(image, image)
    out[:, width], out[:, width + 1] = 0xFF, 0xD0 + nth % 8
    stuffed = live & (out == 0xFF)
    live[:, width:] = ~last[:, None]
    times = live.astype(np.int8) + stuffed
    total = np.bincount(image, times.sum(axis=1), images).astype(np.int64)
    flat, reps = out.ravel(), times.ravel()
    ends = np.cumsum(reps, dtype=np.int64)
    done = np.repeat(flat, reps)
    done[ends[reps == 2] - 1] = 0
    raw, cuts = done.tobytes(), np.concatenate([[0], np.cumsum(total)]).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _bits(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes (most significant bit first) as bytes, padded with ones; and the bytes of each row."""
    ends = np.cumsum(lengths, axis=1)
    total = ends[:, -1]
    width = int(total.max(initial=0)) + 7 & ~7
    bits = np.ones((len(codes), width), np.uint8)
    row = np.arange(len(codes))[:, None]
    for b in range(int(lengths.max(initial=0))):
        r, c = np.nonzero(lengths > b)
        bits[r, ends[r, c] - 1 - b] = codes[r, c] >> b & 1
    del row
    return np.packbits(bits, axis=1), -(-total // 8)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload; ``decode`` gives the bytes back (and fill after them)."""
    k = len(payloads)
    if not k:
        return []
    rows, cols = np.array([geometry(len(p)) for p in payloads]).T
    mcus = rows * cols
    # bytes by component: luma blocks in raster order, then both chroma planes
    full = [p.ljust(384 * n, bytes([FILL])) for p, n in zip(payloads, mcus.tolist(), strict=True)]
    parts = [[f[: 256 * n] for f, n in zip(full, mcus.tolist(), strict=True)], [f[256 * n : 320 * n] for f, n in zip(full, mcus.tolist(), strict=True)], [f[320 * n :] for f, n in zip(full, mcus.tolist(), strict=True)]]
    byte = [np.frombuffer(b"".join(p), np.uint8).reshape(-1, 64) for p in parts]
    # |coefficient| is byte or 255 - byte; without its low bit it has 7 bits, written inverted for negative ones
    size = [np.where(b >= 128, b, 255 - b) for b in byte]
    first = [np.where(b >= 128, s >> 1, s >> 1 ^ 127).astype(np.uint8) for b, s in zip(byte, size, strict=True)]
    deal = [_segments(mcus * 4), *[_segments(mcus)] * 2]
    scans: list[list[bytes]] = []

    # DC: value without its low bit, as a difference within the segment
    dc = [np.where(b[:, 0] >= 128, b[:, 0].astype(np.int32), b[:, 0].astype(np.int32) - 255) for b in byte]
    grid, image, last = deal[1]
    unit = np.maximum(grid, 0)
    width = np.repeat(cols, mcus)
    mcu = np.arange(mcus.sum()) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    corner = np.repeat(4 * (np.cumsum(mcus) - mcus), mcus) + mcu // width * 4 * width + mcu % width * 2
    luma = np.stack([corner, corner + 1, corner + 2 * width, corner + 2 * width + 1], axis=1)  # blocks of each macro block
    values = np.concatenate([dc[0][luma[unit]], dc[1][unit][..., None], dc[2][unit][..., None]], axis=2)  # segment, unit, block
    high = values >> 1
    flat_luma = high[:, :, :4].reshape(len(grid), -1)
    diff = high.copy()
    diff[:, :, :4] = np.diff(flat_luma, axis=1, prepend=0).reshape(len(grid), RESTART, 4)
    diff[:, :, 4:] = np.diff(high[:, :, 4:], axis=1, prepend=0)
    diff = diff.reshape(len(grid), -1)
    magnitude = np.abs(diff)
    bits = np.where(magnitude > 0, np.frexp(magnitude.astype(np.float64))[1], 0)
    real = np.repeat(grid >= 0, 6, axis=1)
    tail = np.where(diff < 0, diff + (1 << bits) - 1, diff)
    packed, sizes = _bits(np.where(real, 4 + bits, 0), bits << bits | tail)
    scans.append(_stream(packed, sizes, image, last, k))

    # AC without low bits: one byte a coefficient
    for low, high_end in ((1, 5), (6, 63)):
        for c in range(3):
            g, im, la = deal[c]
            data = first[c][np.maximum(g, 0)][:, :, low : high_end + 1].reshape(len(g), -1)
            scans.append(_stream(data, (g >= 0).sum(axis=1) * (high_end + 1 - low), im, la, k))

    # low bits of DC, then of AC: an end-of-block run over the segment, and a bit for each coefficient
    low_bits = (values & 1).reshape(len(grid), -1)
    packed, sizes = _bits(real.astype(np.int64), low_bits)
    scans.append(_stream(packed, sizes, image, last, k))
    prefix = {1: [0, 0], 2: [0, 1, 0], 3: [0, 1, 1], 4: [1, 0, 0, 0]}
    for c in range(3):
        g, im, la = deal[c]
        blocks = (g >= 0).sum(axis=1)
        out = np.zeros((len(g), (RESTART * 63 + 4 + 7) // 8), np.uint8)
        sizes = np.zeros(len(g), np.int64)
        low_bits = size[c] & 1
        for n, head in prefix.items():
            at = np.flatnonzero(blocks == n)
            if len(at):
                total = len(head) + 63 * n
                bit = np.ones((len(at), total + 7 & ~7), np.uint8)
                bit[:, : len(head)] = head
                bit[:, len(head) : total] = low_bits[g[at][:, :n]][:, :, 1:].reshape(len(at), -1)
                done = np.packbits(bit, axis=1)
                out[at, : done.shape[1]], sizes[at] = done, done.shape[1]
        scans.append(_stream(out, sizes, im, la, k))

    result = []
    for i in range(k):
        frame = _marker(0xC2, bytes([8]) + int(16 * rows[i]).to_bytes(2, "big") + int(16 * cols[i]).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        body = b"".join(x for s, data in zip(_SCANS, scans, strict=True) for x in (s, data[i]))
        result.append(b"".join([_HEAD, frame, _DC, _FIRST, _RUNS, _marker(0xDD, RESTART.to_bytes(2, "big")), body, b"\xff\xd9"]))
    return result


# ---------------------------------------------------------------- reading

_MARK = re.compile(rb"\xff[^\x00\xff]")


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quantiser: int
    rows: int = 0
    cols: int = 0
    high: int = 0  # rows and columns of blocks without the padding to whole macro blocks
    wide: int = 0
    base: int = 0  # first block in the batch's coefficient array


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)


class _Batch:
    """Segments of all scans of a batch of images, as lists that become numpy columns."""

    def __init__(self) -> None:
        self.images: list[Image] = []
        self.blocks = 0
        self.tables: dict[bytes, int] = {}
        self.luts: list[np.ndarray] = []
        self.data: list[bytes] = []
        self.scans: list[tuple] = []  # image, components, low, high, was, shift, tables, [first unit, units, segment number]

    def table(self, body: bytes) -> int:
        got = self.tables.get(body)
        if got is None:
            lut = np.zeros(65536, np.uint16)
            at = code = 0
            for size in range(1, 17):
                for _ in range(body[size - 1]):
                    low = code << 16 - size
                    lut[low : low + (1 << 16 - size)] = size << 8 | body[16 + at]
                    code, at = code + 1, at + 1
                code <<= 1
            got = self.tables[body] = len(self.luts)
            self.luts.append(lut)
        return got

    def add(self, raw: bytes) -> None:
        if raw[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        image, huffman, restart, at = Image(), {}, 0, 2
        marks = [m.start() for m in _MARK.finditer(raw)]
        index = {m: i for i, m in enumerate(marks)}
        while True:
            kind = raw[at + 1]
            if kind == 0xD9:
                break
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            body = raw[at + 4 : at + 2 + size]
            following = at + 2 + size
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide, n = body[i] >> 4, 128 if body[i] >> 4 else 64
                    image.quantisers[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                    i += 1 + n
            elif kind == 0xC2:
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
                if body[0] != 8 or len(image.components) not in (1, 3) or not image.width or not image.height or not all(c.h and c.v for c in image.components):
                    raise ValueError("only 8-bit images of one or three components are read")
                if len(image.components) == 1:  # alone, a component has one block a macro block
                    image.components[0].h = image.components[0].v = 1
                top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
                across, down = -(-image.width // (8 * top_h)), -(-image.height // (8 * top_v))
                for c in image.components:
                    c.rows, c.cols, c.base = down * c.v, across * c.h, self.blocks
                    c.high, c.wide = -(-image.height * c.v // (8 * top_v)), -(-image.width * c.h // (8 * top_h))
                    self.blocks += c.rows * c.cols
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    huffman[body[i]] = self.table(body[i + 1 : i + 17 + n])
                    i += 17 + n
            elif kind == 0xDD:
                restart = int.from_bytes(body, "big")
            elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("only progressive Huffman-coded frames are read")
            elif kind == 0xDA:
                k = body[0]
                chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * j]), body[2 + 2 * j]) for j in range(k)]
                low, high, approx = body[1 + 2 * k : 4 + 2 * k]
                # the segments run from mark to mark; the first mark that is no restart ends the scan
                i = index.get(following)
                if i is None:
                    import bisect

                    i = bisect.bisect_left(marks, following)
                begin, count = following, 0
                while True:
                    stop = marks[i]
                    self.data.append(raw[begin:stop].replace(b"\xff\x00", b"\xff"))
                    count += 1
                    begin, i = stop + 2, i + 1
                    if not 0xD0 <= raw[stop + 1] <= 0xD7:
                        break
                tables = [huffman.get(t >> 4 if low == 0 else 0x10 | t & 15, 0) for _, t in chosen]
                self.scans.append((image, [c for c, _ in chosen], low, high, approx >> 4, approx & 15, tables, count, restart))
                following = stop
            at = following
        if not image.components:
            raise ValueError("no frame")
        self.images.append(image)


def _window(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The 56 bits or more from each bit position on, at the top of a 64-bit word."""
    return words[pos >> 3] << (pos & 7).astype(np.uint64)


def _take(window: np.ndarray, used: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` bits after the first ``used`` ones (0 for n = 0)."""
    got = (window << used.astype(np.uint64)) >> (np.uint64(64) - np.maximum(n, 1).astype(np.uint64))
    return np.where(n > 0, got, 0).astype(np.int64)


def _extend(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (bits < (1 << np.maximum(n, 1) - 1)), bits - (1 << n) + 1, bits)


def _coefficients(batch: _Batch) -> np.ndarray:
    """All coefficients of the batch in zigzag order, (blocks, 64)."""
    out = np.zeros(batch.blocks * 64, np.int32)
    sizes = np.array([len(d) for d in batch.data], np.int64)
    begin = (np.cumsum(sizes) - sizes) * 8
    stop = begin + sizes * 8
    raw = np.frombuffer(b"".join(batch.data) + b"\xff" * 16, np.uint8)
    words = np.zeros(len(raw) - 8, np.uint64)
    for i in range(8):
        words |= raw[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
    luts = np.concatenate(batch.luts) if batch.luts else np.zeros(65536, np.uint16)
    groups: dict[tuple, list] = {}
    at = 0
    for scan in batch.scans:
        image, chosen, low, high, was, shift, tables, count, restart = scan
        # first passes depend on nothing; refinements on the pass before, so higher bits go first
        key = (was > 0, -shift if was else 0, low > 0)
        groups.setdefault(key, []).append((at, scan))
        at += count
    for (refine, _, ac), scans in sorted(groups.items()):
        if ac:
            cols = _ac_segments(scans)
            (_refine_ac if refine else _first_ac)(out, raw, words, luts, begin, stop, *cols)
        else:
            _dc(out, raw, words, luts, begin, stop, scans, refine)
    return out.reshape(-1, 64)


def _ac_segments(scans: list[tuple[int, tuple]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The stored block of each coded one, and by segment: its number, first coded block, end block, low, high, shift, table (one component a scan).

    Such scans code a component's own blocks only, without the padding to whole macro blocks.
    """
    rows, places, first = [], [], 0
    for at, (_, (c,), low, high, _, shift, (table,), count, restart) in scans:
        total = c.wide * c.high
        unit = np.arange(total)
        places.append(c.base + unit // c.wide * c.cols + unit % c.wide)
        rows.append((at, first, total, restart or total, low, high, shift, table, count))
        first += total
    at, base, total, step, low, high, shift, table, count = np.array(rows, np.int64).T
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, base, total, step, low, high, shift, table = (np.repeat(x, count) for x in (at, base, total, step, low, high, shift, table))
    block, end = base + nth * step, base + np.minimum((nth + 1) * step, total)
    if (block >= end).any():
        raise ValueError("more segments than blocks")
    return np.concatenate(places), [at + nth, block, end, low, high, shift, table]


def _ended(pos: np.ndarray, stop: np.ndarray) -> None:
    if (pos > stop).any():
        raise ValueError("entropy-coded data end early")


def _first_ac(out, raw, words, luts, begin, stop, place, cols) -> None:
    number, block, end, low, high, shift, table = cols
    pos, stop, k = begin[number].copy(), stop[number], low.copy()
    table = table << 16
    while len(block):
        window = _window(words, pos)
        entry = luts[table + (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, run, size = entry >> 8, entry >> 4 & 15, entry & 15
        plain = size == 0
        zeros = plain & (run == 15)
        ended = plain & ~zeros
        extra = np.where(ended, run, size)
        bits = _take(window, used, extra)
        pos = pos + used + extra
        k = k + np.where(ended, 0, run)
        if (k > high)[~ended].any():
            raise ValueError("a run of zeros beyond the band")
        put = ~plain
        where = place[block] * 64 + k
        if put.all():
            out[where] = _extend(bits, size) << shift
        else:
            out[where[put]] = (_extend(bits, size) << shift)[put]
        k = k + 1
        done = ended | (k > high)
        block = block + np.where(ended, (1 << np.where(ended, run, 0)) + np.where(ended, bits, 0), done)
        k = np.where(done, low, k)
        live = block < end
        if not live.all():
            _ended(pos[~live], stop[~live])
            pos, stop, k, block, end, low, high, shift, table = (x[live] for x in (pos, stop, k, block, end, low, high, shift, table))


def _refine_ac(out, raw, words, luts, begin, stop, place, cols) -> None:
    number, block, end, low, high, shift, table = cols
    pos, stop, k = begin[number].copy(), stop[number], low.copy()
    table = table << 16
    run = np.zeros(len(block), np.int64)  # zero coefficients still to pass
    fresh = np.zeros(len(block), np.int64)  # value to put after them
    rest = np.zeros(len(block), np.int64)  # blocks of an end-of-block run, this one included
    need = np.ones(len(block), bool)
    while len(block):
        ask = np.flatnonzero(need & (rest == 0))
        if len(ask):
            window = _window(words, pos[ask])
            entry = luts[table[ask] + (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            used, r, size = entry >> 8, entry >> 4 & 15, entry & 15
            ended = (size == 0) & (r < 15)
            extra = np.where(ended, r, size)
            bits = _take(window, used, extra)
            pos[ask] += used + extra
            rest[ask] = np.where(ended, (1 << r) + bits, 0)
            run[ask] = r
            fresh[ask] = np.where(size > 0, np.where(bits > 0, 1, -1) << shift[ask], 0)
            need[ask] = False
        where = place[block] * 64 + k
        now = out[where]
        old = now != 0
        bit = raw[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8) & 1
        out[where] = now + np.where(old & (bit > 0), np.sign(now) << shift, 0)
        pos = pos + old
        if not old.all():
            free = ~old & (rest == 0)
            put = free & (run == 0)
            out[where[put]] = fresh[put]
            need |= put
            run = run - free
        k = k + 1
        done = k > high
        if done.any():
            block = block + done
            k = np.where(done, low, k)
            rest = rest - (done & (rest > 0))
            need |= done
            live = block < end
            if not live.all():
                _ended(pos[~live], stop[~live])
                pos, stop, k, block, end, low, high, shift, table, run, fresh, rest, need = (x[live] for x in (pos, stop, k, block, end, low, high, shift, table, run, fresh, rest, need))


def _dc(out, raw, words, luts, begin, stop, scans, refine: bool) -> None:
    """DC scans: the blocks of each segment in coding order as rows, one column a step."""
    groups: dict[tuple, list] = {}
    for at, s in scans:
        shape = tuple((c.h, c.v) for c in s[1]) if len(s[1]) > 1 else ((1, 1),)
        groups.setdefault((shape, s[8]), []).append((at, s))
    for (shape, restart), members in groups.items():
        where, number, table, shift = [], [], [], []
        per = sum(h * v for h, v in shape)
        for at, (image, chosen, _, _, _, sh, tables, count, _) in members:
            across, down = (chosen[0].cols // shape[0][0], chosen[0].rows // shape[0][1]) if len(chosen) > 1 else (chosen[0].wide, chosen[0].high)
            unit = np.arange(across * down)
            parts = []
            for c, (h, v) in zip(chosen, shape, strict=True):
                for y in range(v):
                    for x in range(h):
                        parts.append(c.base + (unit // across * v + y) * c.cols + unit % across * h + x)
            step = restart or len(unit)
            grid = np.full((count * step, per), -1, np.int64)
            grid[: len(unit)] = np.stack(parts, axis=1)
            where.append(grid.reshape(count, -1))
            number.append(at + np.arange(count))
            table.append(np.tile(np.array(tables), (count, 1)))
            shift.append(np.full(count, sh))
        if len({w.shape[1] for w in where}) > 1:
            widest = max(w.shape[1] for w in where)
            where = [np.pad(w, ((0, 0), (0, widest - w.shape[1])), constant_values=-1) for w in where]
        grid, shift = np.concatenate(where), np.concatenate(shift)
        number = np.concatenate(number)
        pos, table = begin[number].copy(), np.concatenate(table) << 16
        component = [i for i, (h, v) in enumerate(shape) for _ in range(h * v)]
        before = np.zeros((len(grid), len(shape)), np.int64)
        for j in range(grid.shape[1]):
            c, block = component[j % per], grid[:, j]
            live = block >= 0
            if refine:
                bit = (raw[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8) & 1).astype(np.int64)
                out[block[live] * 64] |= (bit << shift)[live].astype(np.int32)
                pos = pos + live
            else:
                window = _window(words, pos)
                entry = luts[table[:, c] + (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                used, size = entry >> 8, entry & 255
                value = before[:, c] + _extend(_take(window, used, size), size)
                before[:, c] = np.where(live, value, before[:, c])
                out[block[live] * 64] = (value << shift)[live]
                pos = pos + np.where(live, used + size, 0)
        _ended(pos, stop[number])


@dataclass
class Decoded:
    """One image: its coefficients by component (blocks, 64) in zigzag order, and its pixels."""

    width: int
    height: int
    coefficients: list[np.ndarray]
    planes: list[np.ndarray]

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor (height, width, 3) of 8-bit samples; chroma is repeated up to luma's size."""
        if len(self.planes) == 1:
            return np.repeat(self.planes[0][: self.height, : self.width, None], 3, axis=2)
        # every plane covers the same area of whole macro blocks
        top = [max(p.shape[i] for p in self.planes) for i in (0, 1)]
        y, cb, cr = (p[np.ix_(np.arange(self.height) * p.shape[0] // top[0], np.arange(self.width) * p.shape[1] // top[1])].astype(np.int32) for p in self.planes)
        cb, cr = cb - 128, cr - 128
        red, green, blue = y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)
        return np.clip(np.stack([red, green, blue], axis=2), 0, 255).astype(np.uint8)


def decode(images: list[bytes]) -> list[Decoded]:
    batch = _Batch()
    for raw in images:
        batch.add(raw)
    coefficients = _coefficients(batch)
    scale = np.ones((batch.blocks, 64)) if any((q != 1).any() for im in batch.images for q in im.quantisers.values()) else None
    if scale is not None:
        for im in batch.images:
            for c in im.components:
                scale[c.base : c.base + c.rows * c.cols] = im.quantisers[c.quantiser]
    pixels = (coefficients if scale is None else coefficients * scale).astype(np.float64) @ _basis()
    pixels = np.clip((pixels.astype(np.int64) + 2048 >> 12) + 128, 0, 255).astype(np.uint8)
    out = []
    for im in batch.images:
        own, planes = [], []
        for c in im.components:
            part = slice(c.base, c.base + c.rows * c.cols)
            own.append(coefficients[part])
            planes.append(pixels[part].reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols))
        out.append(Decoded(im.width, im.height, own, planes))
    return out


def decode_each(images: list[bytes]) -> list[Decoded | str]:
    """``decode``, with a reason for each image that cannot be read; halves are tried apart until it is found."""
    try:
        return decode(images)
    except (ArithmeticError, LookupError, StopIteration, ValueError) as error:
        if len(images) == 1:
            return [str(error) if type(error) is ValueError and error.args else f"broken off ({type(error).__name__})"]
        half = len(images) // 2
        return decode_each(images[:half]) + decode_each(images[half:])


def payload_of(image: Decoded) -> bytes:
    """The bytes that ``encode`` stored, with the fill after them."""
    whole = np.concatenate([c.ravel() for c in image.coefficients])
    return np.where(whole < 0, whole + 255, whole).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- columns

SLICE = 2_000_000


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled with blanks to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def media(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep``, ``n_bytes``, ``payload_bytes`` and the JPEG ``media`` of every whole text."""

    def run(texts: list[str | None]) -> list[list]:
        given = [payload(t) for t in texts]
        out = []
        for s in slices([len(p) for _, p in given], SLICE):
            out += encode([p for _, p in given[s]])
        return [[n for n, _ in given], [len(p) for _, p in given], out]

    return per_text(docs, keep, "n_bytes long, payload_bytes long, media binary", run)


def tensors(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``__keep``, ``height``, ``width`` and ``rgb`` (row-major 8-bit samples, three a pixel) of JPEGs in ``media``; ``reason`` where these are null."""

    def run(batch: list[bytes | None]) -> list[list]:
        h, w, px, why = [], [], [], []
        for s in slices([len(x or b"") for x in batch], SLICE):
            for image in decode_each([x or b"" for x in batch[s]]):
                good = isinstance(image, Decoded)
                h.append(image.height if good else None)
                w.append(image.width if good else None)
                px.append(image.rgb().tobytes() if good else None)
                why.append(None if good else image)
        return [h, w, px, why]

    return per_text(rows, keep, "height int, width int, rgb binary, reason string", run, "media")


def _read_back(batch: list[bytes]) -> list[list]:
    """Per JPEG: the stored payload with fill, and the tensor's shape and channel sums."""
    raw, feature = [], []
    for s in slices([len(x) for x in batch], SLICE):
        for image in decode(batch[s]):
            raw.append(payload_of(image))
            sums = image.rgb().reshape(-1, 3).sum(axis=0, dtype=np.int64)
            feature.append(f"{image.height}x{image.width}:{sums[0]}:{sums[1]}:{sums[2]}")
    return [raw, feature]


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query ``op5_media_columns``: the media column is written, read back and summed up in one pass."""
    rows = media(docs, ["doc_id"]).select(F.col("__keep.doc_id").alias("doc_id"), "n_bytes", "payload_bytes", "media")

    def run(batch: list[bytes]) -> list[list]:
        sizes = [0] * len(batch)
        raw, feature = _read_back(batch)
        sizes = [len(x) for x in batch]
        return [raw, feature, sizes, [hashlib.sha256(x).hexdigest() for x in batch]]

    got = per_text(rows, ["doc_id", "n_bytes", "payload_bytes"], "raw binary, feature string, media_bytes long, media_sha256 string", run, "media")
    body = F.substring(F.col("raw"), F.lit(1), F.col("__keep.payload_bytes").cast("int"))
    tail = F.substring(F.col("raw"), (F.col("__keep.payload_bytes") - 15).cast("int"), F.lit(16))
    return got.select("__keep.*", F.sha2(body, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
