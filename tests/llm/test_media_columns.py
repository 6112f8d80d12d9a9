import hashlib
import zlib

import numpy as np

from normspark.llm import media_columns as M
from tests.llm.conftest import DOCS


class Bits:
    """A plain sequential writer, to check the reader against files that ``encode`` never makes."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def symbol(self, s):
        self.put(s, 8)  # the test's tables have 8-bit codes in order

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def size_of(v):
    return int(abs(v)).bit_length()


def extra(w, v, n):
    if n:
        w.put(v if v > 0 else v + (1 << n) - 1, n)


def shifted(v, al):
    return int(np.sign(v) * (abs(v) >> al))


def dc_scan(blocks, al):
    w, before = Bits(), [0] * len(blocks)
    for i in range(len(blocks[0])):
        for c, comp in enumerate(blocks):
            v = int(comp[i][0]) >> al
            d, before[c] = v - before[c], v
            w.symbol(size_of(d))
            extra(w, d, size_of(d))
    return w.bytes()


def ac_first(comp, low, high, al):
    w, run = Bits(), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0

    for block in comp:
        zeros = 0
        for k in range(low, high + 1):
            v = shifted(int(block[k]), al)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | size_of(v))
            extra(w, v, size_of(v))
            zeros = 0
        if zeros:
            run += 1
    flush()
    return w.bytes()


def ac_refine(comp, low, high, al):
    w = Bits()
    for block in comp:
        now = [shifted(int(block[k]), al) for k in range(64)]
        last = max([k for k in range(low, high + 1) if abs(now[k]) == 1], default=low - 1)
        zeros, pending = 0, []
        for k in range(low, high + 1):
            if k > last:
                break
            if abs(now[k]) > 1:
                pending.append(abs(now[k]) & 1)
            elif now[k] == 0:
                zeros += 1
                if zeros == 16:
                    w.symbol(0xF0)
                    w.bits += pending
                    zeros, pending = 0, []
            else:
                w.symbol(zeros << 4 | 1)
                w.put(int(now[k] > 0), 1)
                w.bits += pending
                zeros, pending = 0, []
        if last < high:
            w.symbol(0x00)
            w.bits += pending
            w.bits += [abs(now[k]) & 1 for k in range(last + 1, high + 1) if abs(now[k]) > 1]
        else:
            assert not pending
    return w.bytes()


def sparse_file(blocks, quant):
    """A 4:4:4 image 8 pixels high with sparse coefficients, two refinements and no restarts."""
    n = len(blocks[0])
    table = lambda kind: M._marker(0xC4, bytes([kind, *[0] * 7, 0xFB, *[0] * 8, *range(0xFB)]))
    head = b"\xff\xd8" + M._marker(0xDB, bytes([0]) + bytes(quant)) + M._marker(0xC2, bytes([8]) + (8).to_bytes(2, "big") + (8 * n).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out = head + table(0x00) + table(0x10)
    out += M._scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1) + dc_scan(blocks, 1)
    for c in range(3):
        for low, high in ((1, 9), (10, 63)):
            out += M._scan([(c + 1, 0)], low, high, 0, 2) + ac_first(blocks[c], low, high, 2)
    for was, al in ((2, 1), (1, 0)):
        for c in range(3):
            out += M._scan([(c + 1, 0)], 1, 63, was, al) + ac_refine(blocks[c], 1, 63, al)
    refine = Bits()
    for i in range(n):
        for comp in blocks:
            refine.put(int(comp[i][0]) & 1, 1)
    return out + M._scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0) + refine.bytes() + b"\xff\xd9"


def test_reads_sparse_refined_files():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        blocks = rnd.integers(-60, 60, (3, n, 64)) * (rnd.random((3, n, 64)) < 0.15)
        blocks[:, : n // 2, 20:] = 0
        (got,) = M.decode([sparse_file(blocks, [1] * 64)])
        assert all((got.coefficients[c] == blocks[c]).all() for c in range(3))


def odd_file(width, height, shape, rnd):
    """A file of any sides and sampling, and its coefficients by component with the padding to whole macro blocks."""
    top = [max(x) for x in zip(*shape, strict=True)] if len(shape) > 1 else [1, 1]
    across, down = -(-width // (8 * top[0])), -(-height // (8 * top[1]))
    comps, real = [], []
    for h, v in shape if len(shape) > 1 else [(1, 1)]:
        grid = rnd.integers(-40, 40, (down * v, across * h, 64)) * (rnd.random((down * v, across * h, 64)) < 0.2)
        size = -(-height * v // (8 * top[1])), -(-width * h // (8 * top[0]))
        outside = np.ones(grid.shape[:2], bool)
        outside[: size[0], : size[1]] = False
        grid[outside, 1:] = 0  # scans of one component do not code the padding
        comps.append(grid)
        real.append(grid[: size[0], : size[1]].reshape(-1, 64))
    table = lambda kind: M._marker(0xC4, bytes([kind, *[0] * 7, 0xFB, *[0] * 8, *range(0xFB)]))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(shape), *(x for i, (h, v) in enumerate(shape) for x in (i + 1, h << 4 | v, 0))])
    out = b"\xff\xd8" + M._marker(0xDB, bytes([0] + [1] * 64)) + M._marker(0xC2, frame) + table(0x00) + table(0x10)
    w, before = Bits(), [0] * len(shape)
    order = [(c, y * v + j, x * h + i) for y in range(down) for x in range(across) for c, (h, v) in enumerate(shape if len(shape) > 1 else [(1, 1)]) for j in range(v) for i in range(h)]
    for c, y, x in order:
        value = int(comps[c][y, x, 0])
        d, before[c] = value - before[c], value
        w.symbol(size_of(d))
        extra(w, d, size_of(d))
    out += M._scan([(i + 1, 0) for i in range(len(shape))], 0, 0, 0, 0) + w.bytes()
    for c, blocks in enumerate(real):
        out += M._scan([(c + 1, 0)], 1, 63, 0, 1) + ac_first(blocks, 1, 63, 1)
        out += M._scan([(c + 1, 0)], 1, 63, 1, 0) + ac_refine(blocks, 1, 63, 0)
    return out + b"\xff\xd9", comps


CASES = [(17, 9, [(2, 2), (1, 1), (1, 1)]), (1, 1, [(2, 1), (1, 1), (1, 1)]), (30, 41, [(1, 2), (1, 1), (1, 1)]), (23, 50, [(1, 1)]), (40, 8, [(2, 2)]), (33, 33, [(4, 1), (2, 1), (1, 1)]), (50, 20, [(1, 1), (2, 2), (1, 2)])]


def test_reads_any_sides_and_grey_images():
    rnd = np.random.default_rng(6)
    made = [odd_file(*case, rnd) for case in CASES]
    for (width, height, _), (_, comps), got in zip(CASES, made, M.decode([raw for raw, _ in made]), strict=True):
        assert got.rgb().shape == (height, width, 3)
        assert all((a == b.reshape(-1, 64)).all() for a, b in zip(got.coefficients, comps, strict=True))


def test_what_cannot_be_read_has_a_reason(spark):
    raw, _ = odd_file(*CASES[0], np.random.default_rng(7))
    good = M.encode([b"x" * 192])[0]
    bad = [b"", b"GIF89a", raw[:300], raw[: len(raw) * 2 // 3], good[:40], good[:-400], b"\xff\xd8\xff\xd9", raw.replace(b"\xff\xc2", b"\xff\xc0"), b"\xff\xd8" + bytes(range(256)) * 3]
    rows = [(i, x) for i, x in enumerate([good, raw, *bad, None, good])]
    got = {r.i: r for r in M.tensors(spark.createDataFrame(rows, "i int, media binary"), ["i"]).select("__keep.i", "height", "width", "rgb", "reason").collect()}
    for i, r in got.items():
        assert (r.reason is None) == (i in (0, 1, len(rows) - 1)) == (r.rgb is not None), (i, r.reason)
    assert got[0].rgb == got[len(rows) - 1].rgb and len(got[1].rgb) == 3 * 17 * 9


def test_pixels_equal_the_plain_inverse_transform():
    rnd = np.random.default_rng(4)
    blocks = rnd.integers(-20, 20, (3, 4, 64)) * (rnd.random((3, 4, 64)) < 0.2)
    quant = [1 + i % 5 for i in range(64)]
    (got,) = M.decode([sparse_file(blocks, quant)])
    for c in range(3):
        for b in range(4):
            f = np.zeros((8, 8))
            f.flat[M.zigzag()] = blocks[c, b] * quant
            want = np.zeros((8, 8))
            for u in range(8):
                for v in range(8):
                    s = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    want += s * f[u, v] * np.outer(np.cos((2 * np.arange(8) + 1) * u * np.pi / 16), np.cos((2 * np.arange(8) + 1) * v * np.pi / 16))
            assert np.abs(got.planes[c][:, 8 * b : 8 * b + 8] - np.clip(want + 128, 0, 255)).max() <= 1
    assert got.rgb().shape == (8, 32, 3)


def test_round_trip_of_any_bytes():
    rnd = np.random.default_rng(5)
    payloads = [rnd.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 5, 16, 77)] + [bytes([v]) * 192 for v in (0, 32, 127, 128, 255)]
    images = M.encode(payloads)
    assert [M.payload_of(d)[: len(p)] for d, p in zip(M.decode(images), payloads, strict=True)] == payloads
    assert images == [M.encode([p])[0] for p in payloads]
    grey = M.decode(M.encode([b"\x80" * 384]))[0]
    assert grey.planes[1].shape == (8, 8) and grey.rgb().shape == (16, 16, 3)
    assert M.encode([]) == [] and M.decode([]) == []


def test_query(spark, docs, corpus, empty, clashing):
    rows = M.digest(docs).collect()
    want = {}
    for i, text, *_ in corpus:
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[i] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
    same = {r.doc_id: (r.media_sha256, r.feature) for r in rows}
    assert same[1] == same[105] and same[100] == same[101]
    assert M.digest(empty).count() == 0 and M.digest(clashing).count() == len(corpus)


def test_tensor_column(spark):
    df = spark.createDataFrame([(1, "hello " * 80, "en", "s", 0), (2, None, None, None, None)], DOCS)
    rows = M.tensors(M.media(df, ["doc_id"]).select("__keep.*", "media"), ["doc_id"]).select("__keep.doc_id", "height", "width", "rgb").collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in rows)
