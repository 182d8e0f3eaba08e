"""PNG (gray, RGB, indexed) and baseline JPEG encoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Quantisation tables and Huffman tables of the JPEG standard, zigzag order.
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
# Brightness and chroma of red, green and blue in parts of 65,536, and what is added to chroma.
YCC = [(19_595, 38_470, 7_471), (-11_059, -21_709, 32_768), (32_768, -27_439, -5_329)]
OFFSET = (128 << 16) + 32_767
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def _png(w: int, h: int, depth: int, kind: int, rows: np.ndarray, step: int, palette: bytes = b"") -> bytes:
    """Rows with the one of the five filters whose differences are smallest, for whole-byte pixels."""
    if step:
        left = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]]
        up = np.pad(rows, ((1, 0), (0, 0)))[: len(rows)]
        corner = np.pad(left, ((1, 0), (0, 0)))[: len(rows)]
        x, y, z = (v.astype(np.int16) for v in (left, up, corner))
        off = np.abs(np.stack((y - z, x - z, x + y - 2 * z)))  # from the guess x + y - z to x, y and z
        nearest = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], up, corner))
        forms = np.stack((rows, rows - left, rows - up, rows - ((x + y) >> 1).astype(np.uint8), rows - nearest))
        cost = np.abs(forms.astype(np.int8).astype(np.int32)).sum(2)
        best = np.argmin(cost, axis=0)
        rows = forms[best, np.arange(len(rows))]
    else:
        best = np.zeros(len(rows), np.uint8)
    body = np.concatenate((best.astype(np.uint8)[:, None], rows), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + (_chunk(b"PLTE", palette) if palette else b"") + _chunk(b"IDAT", zlib.compress(body, 9)) + _chunk(b"IEND", b"")


def png(a: np.ndarray) -> bytes:
    h, w = a.shape[:2]
    step = 1 if a.ndim == 2 else 3
    return _png(w, h, 8, 0 if step == 1 else 2, np.ascontiguousarray(a).reshape(h, w * step), step)


def indexed_png(index: np.ndarray, levels: list[int]) -> bytes:
    """One, two or four bits a pixel, as the palette needs."""
    depth = 1 if len(levels) <= 2 else 2 if len(levels) <= 4 else 4
    h, w = index.shape
    bits = (index[..., None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(h, w * depth)
    return _png(w, h, depth, 3, np.packbits(bits, axis=1), 0, bytes(v for g in levels for v in (g, g, g)))


def _quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255).reshape(8, 8) for t in (LUMA, CHROMA)]


def _lengths(counts: np.ndarray) -> list[tuple[int, int]]:
    """Code lengths of at most 16 bits for symbol counts, shortest first; no code is all ones."""
    import heapq

    n = np.append(counts, 1)  # the last one keeps the all-ones code free
    heap = [(int(c), i, [i]) for i, c in enumerate(n) if c]
    size = dict.fromkeys((i for _, i, _ in heap), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            size[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]) - 1000, a[2] + b[2]))
    per = [0] * 64
    for v in size.values():
        per[max(v, 1)] += 1
    for i in range(63, 16, -1):  # the standard's way to shorten
        while per[i]:
            j = i - 2
            while not per[j]:
                j -= 1
            per[i] -= 2
            per[i - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    longest = max(i for i in range(17) if per[i])
    per[longest] -= 1
    symbols = sorted((i for i in size if i < len(counts)), key=lambda i: (size[i], i))
    return list(zip([k for k in range(17) for _ in range(per[k])], symbols, strict=True))


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1]


def _events(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table (0, 2: DC; 1, 3: AC), symbol, further bits and their number, in the order of the scan; units: groups x blocks x 64 of each component."""
    per = [u.shape[1] for u in units]
    blocks = np.concatenate(units, axis=1)
    component = np.tile(np.repeat(np.arange(len(units)), per), len(blocks))
    diff = np.concatenate([np.diff(u[..., 0].ravel(), prepend=0).reshape(u.shape[:2]) for u in units], axis=1).ravel()
    blocks = blocks.reshape(-1, 64)
    row, k = np.nonzero(blocks[:, 1:])
    k += 1
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    run = k - np.where(first, 0, np.concatenate(([0], k[:-1]))) - 1
    last = np.zeros(len(blocks), np.int64)
    last[row] = k  # the highest place comes last
    ended = np.flatnonzero(last < 63)
    long_ = run >> 4
    skips = np.repeat(np.arange(len(row)), long_)
    # A place in the scan: block, then twice the coefficient, runs of 16 zeros before it.
    place = np.concatenate((np.arange(len(blocks)) << 8, (row[skips] << 8) + 2 * k[skips], (row << 8) + 2 * k + 1, (ended << 8) + 255))
    ac = blocks[row, k]
    size = [_bit_length(diff), np.zeros(len(skips), np.int64), _bit_length(ac), np.zeros(len(ended), np.int64)]
    symbol = np.concatenate((size[0], np.full(len(skips), 0xF0), (run & 15) << 4 | size[2], size[3]))
    value = np.concatenate((diff, size[1], ac, size[3]))
    width = np.concatenate(size)
    value = np.where(value < 0, value + (1 << width) - 1, value)
    table = 2 * np.minimum(component, 1)
    table = np.concatenate((table, table[row[skips]] + 1, table[row] + 1, table[ended] + 1))
    order = np.argsort(place, kind="stable")
    return table[order], symbol[order], value[order], width[order].astype(np.int64)


def _packed(word: np.ndarray, size: np.ndarray) -> bytes:
    """The words' lowest `size` bits in a row, filled up with ones."""
    out = []
    for a in range(0, len(word), 1 << 18):
        w, n = word[a : a + (1 << 18)], size[a : a + (1 << 18)]
        ends = np.cumsum(n)
        shift = np.repeat(ends, n) - 1 - np.arange(ends[-1])
        out.append((np.repeat(w, n) >> shift & 1).astype(np.uint8))
    bits = np.concatenate(out)
    return np.packbits(np.append(bits, np.ones(-len(bits) % 8, np.uint8))).tobytes()


def entropy(units: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Huffman tables made for these coefficients, as a segment's body, and the scan; the first component has tables of its own."""
    table, symbol, value, width = _events(units)
    codes, lengths, huffman = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64), b""
    for t in range(2 * min(len(units), 2)):
        chosen = _lengths(np.bincount(symbol[table == t], minlength=256))
        code = before = 0
        for n, s in chosen:
            code <<= n - before
            before = n
            codes[t, s], lengths[t, s] = code, n
            code += 1
        per = [sum(n == i for n, _ in chosen) for i in range(1, 17)]
        huffman += bytes([(t % 2) << 4 | t // 2, *per, *(s for _, s in chosen)])
    word, size = codes[table, symbol] << width | value, lengths[table, symbol] + width
    scan = _packed(word, size).replace(b"\xff", b"\xff\x00")
    return huffman, scan


def jpeg(a: np.ndarray, quality: int) -> bytes:
    """Baseline JPEG with its own Huffman tables; colour has its chroma halved both ways."""
    h, w = a.shape[:2]
    if max(h, w) > 65_535 or not 1 <= quality <= 100:
        raise ValueError("size or quality out of range")
    if a.ndim == 2:
        planes, sampling = [a.astype(np.float64)], [1]
    else:
        r, g, b = (a[..., i].astype(np.float64) for i in range(3))
        fixed = np.tensordot(a.astype(np.int64), np.array(YCC).T, 1) + (32_768, OFFSET, OFFSET) >> 16
        luma, cb, cr = np.moveaxis(fixed.astype(np.float64), -1, 0)
        planes, sampling = [luma, *(_halved(c) for c in (cb, cr))], [2, 1, 1]
    unit = 8 * sampling[0]
    mh, mw = -(-h // unit), -(-w // unit)
    tables = _quantisers(quality)
    k = np.arange(8)
    dct = np.where(k[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    zigzag = np.array(ZIGZAG)
    units = []
    for i, (plane, s) in enumerate(zip(planes, sampling, strict=True)):
        ph, pw = mh * 8 * s, mw * 8 * s
        p = np.pad(plane, ((0, ph - plane.shape[0]), (0, pw - plane.shape[1])), mode="edge") - 128.0
        blocks = p.reshape(mh * s, 8, mw * s, 8).transpose(0, 2, 1, 3)
        c = dct @ blocks @ dct.T / tables[min(i, 1)]
        c = (np.sign(c) * np.floor(np.abs(c) + 0.5)).astype(np.int64).reshape(mh * s, mw * s, 64)[..., zigzag]
        units.append(c.reshape(mh, s, mw, s, 64).transpose(0, 2, 1, 3, 4).reshape(mh * mw, s * s, 64))
    huffman, scan = entropy(units)
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    quant = b"".join(bytes([i, *tables[i].ravel()[zigzag].tolist()]) for i in range(min(len(units), 2)))
    frame = struct.pack(">BHHB", 8, h, w, len(units)) + b"".join(bytes([i + 1, s << 4 | s, min(i, 1)]) for i, s in enumerate(sampling))
    start = bytes([len(units)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(units))) + b"\x00\x3f\x00"
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + segment(0xDB, quant) + segment(0xC0, frame) + segment(0xC4, huffman) + segment(0xDA, start) + scan + b"\xff\xd9"


def _halved(p: np.ndarray) -> np.ndarray:
    """Means of four, rounded with a bias of 1 and 2 in turn."""
    p = np.pad(p, ((0, p.shape[0] % 2), (0, p.shape[1] % 2)), mode="edge").astype(np.int64)
    total = p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]
    return ((total + 1 + np.arange(total.shape[1]) % 2) >> 2).astype(np.float64)
