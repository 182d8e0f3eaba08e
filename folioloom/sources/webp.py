"""Lossless WebP: prefix codes, references backwards with a two-dimensional distance map, a colour cache and four inverse transforms.

Symbols are read one by one, since each says where the next begins; all transforms work on whole planes. Prediction depends on the left,
upper and upper right neighbours, so pixels with equal x + 2 y are independent and are predicted together.
"""

from __future__ import annotations

import struct

import numpy as np

# The order in which lengths of the code for lengths are stored; alphabets but for the cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Hash of the colour cache.
SPREAD = 0x1E35A7BD


class WebpError(ValueError):
    pass


def near_places() -> list[tuple[int, int]]:
    """The short distances by code: (columns to the left, rows up), nearest first, then by columns, to the left before to the right."""
    every = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(every, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


NEAR = near_places()


class Bits:
    """Bits of a chunk, lowest first."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
        n = len(data)
        self.windows = (padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 24).tolist()
        self.at, self.size = 0, 8 * n

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise WebpError("the image ends early")
        value = (self.windows[self.at >> 3] >> (self.at & 7)) & ((1 << n) - 1) if n else 0
        self.at += n
        return value


class Code:
    """A canonical prefix code as a table over the next `bits` bits: symbols with their lengths."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1:
            self.bits, self.table = 0, [(used[0], 0)]
            return
        if not used:
            raise WebpError("a code without symbols")
        self.bits = max(lengths)
        self.table = [(-1, 0)] * (1 << self.bits)
        code, counts = 0, np.bincount([lengths[s] for s in used], minlength=self.bits + 1).tolist()
        if sum(c << (self.bits - n) for n, c in enumerate(counts) if n) != 1 << self.bits:
            raise WebpError("a code that is not complete")
        for n in range(1, self.bits + 1):
            for s in (s for s in used if lengths[s] == n):
                turned = int(f"{code:0{n}b}"[::-1], 2)
                self.table[turned :: 1 << n] = [(s, n)] * (1 << (self.bits - n))
                code += 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        if bits.at >= bits.size:
            if not self.bits:
                return self.table[0][0]
            raise WebpError("the image ends early")
        symbol, n = self.table[(bits.windows[bits.at >> 3] >> (bits.at & 7)) & ((1 << self.bits) - 1)]
        bits.at += n
        return symbol


def _code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # one or two symbols
        lengths = [0] * max(alphabet, LITERALS)
        two = bits.read(1)
        for wide in [bits.read(1), *[1] * two]:
            lengths[bits.read(8 if wide else 1)] = 1
        return Code(lengths)
    of_lengths = [0] * len(LENGTH_ORDER)
    for s in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[s] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths: list[int] = []
    before = 8
    while len(lengths) < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths.append(s)
            before = s or before
        else:
            value, least, n = {16: (before, 3, 2), 17: (0, 3, 3), 18: (0, 11, 7)}[s]
            lengths += [value] * (least + bits.read(n))
    if len(lengths) > alphabet:
        raise WebpError("lengths of a code beyond its alphabet")
    return Code(lengths + [0] * (alphabet - len(lengths)))


def _value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _entropy_image(bits: Bits, w: int, h: int, top: bool) -> np.ndarray:
    """Pixels as 0xAARRGGBB of an image of its own codes; only the image itself may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("a colour cache too large")
    tile, groups, of_tile, across = 0, 1, [0], 1
    if top and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-w >> tile)
        told = _entropy_image(bits, across, -(-h >> tile), False)
        of_tile = (told.ravel() >> 8 & 0xFFFF).tolist()
        groups = max(of_tile) + 1
    alphabets = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [tuple(_code(bits, n) for n in alphabets) for _ in range(groups)]
    total, out, y, x = w * h, [0] * (w * h), 0, 0
    cache, shift, cached = [0] * (1 << cache_bits), 32 - cache_bits, 0  # pixels before `cached` are in the cache
    windows, size, at, n = bits.windows, bits.size, bits.at, 0
    green, red, blue, alpha, far = codes[of_tile[0]]
    plain = [0, 0, 0]
    while n < total:
        if groups > 1 or n == 0:
            y, x = divmod(n, w)
            green, red, blue, alpha, far = codes[of_tile[(y >> tile) * across + (x >> tile)]]
            stop = min(n - x + w, n - x + ((x >> tile) + 1 << tile)) if groups > 1 else total
            fixed = not (red.bits or blue.bits or alpha.bits)
            plain = alpha.table[0][0] << 24 | red.table[0][0] << 16 | blue.table[0][0]
            gt, gm, rt, rm, bt, bm, at_, am = green.table, (1 << green.bits) - 1, red.table, (1 << red.bits) - 1, blue.table, (1 << blue.bits) - 1, alpha.table, (1 << alpha.bits) - 1
        while n < stop:
            if at >= size:
                if at > size or gm or n == 0 and size:
                    raise WebpError("the image ends early")
                s, k = gt[0]
            else:
                s, k = gt[(windows[at >> 3] >> (at & 7)) & gm]
            at += k
            if s < LITERALS:
                if fixed:
                    out[n] = plain | s << 8
                else:
                    r, k = rt[(windows[at >> 3] >> (at & 7)) & rm] if at < size else rt[0]
                    at += k
                    b, k = bt[(windows[at >> 3] >> (at & 7)) & bm] if at < size else bt[0]
                    at += k
                    a, k = at_[(windows[at >> 3] >> (at & 7)) & am] if at < size else at_[0]
                    at += k
                    out[n] = a << 24 | r << 16 | s << 8 | b
                n += 1
            elif s < LITERALS + LENGTHS:
                bits.at = at
                length = _value(bits, s - LITERALS)
                code = _value(bits, far.read(bits))
                at = bits.at
                if code > len(NEAR):
                    back = code - len(NEAR)
                else:
                    dx, dy = NEAR[code - 1]
                    back = max(1, dx + dy * w)
                if back > n or n + length > total:
                    raise WebpError("a reference out of the image")
                if back >= length:
                    out[n : n + length] = out[n - back : n - back + length]
                else:
                    part = out[n - back : n]
                    out[n : n + length] = (part * (length // back + 1))[:length]
                n += length
                if n > stop:
                    break
            else:
                for p in out[cached:n]:
                    cache[(p * SPREAD & 0xFFFFFFFF) >> shift] = p
                cached = n
                if s - LITERALS - LENGTHS >= len(cache):
                    raise WebpError("a colour beyond the cache")
                out[n] = cache[s - LITERALS - LENGTHS]
                n += 1
        if at > size:
            raise WebpError("the image ends early")
    bits.at = at
    return np.array(out, np.uint32).reshape(h, w)


def _planes(pixels: np.ndarray) -> np.ndarray:
    """height, width and channels a, r, g, b."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=2).astype(np.int16)


def predicted(left: np.ndarray, up: np.ndarray, right: np.ndarray, corner: np.ndarray, mode: int) -> np.ndarray:
    """A prediction from the left, upper, upper right and upper left neighbours."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0], np.int16), left.shape)
    if mode < 5:
        return (left, up, right, corner)[mode - 1]
    if mode < 11:
        return {5: lambda: mean(mean(left, right), up), 6: lambda: mean(left, corner), 7: lambda: mean(left, up), 8: lambda: mean(corner, up), 9: lambda: mean(up, right), 10: lambda: mean(mean(left, corner), mean(up, right))}[mode]()
    if mode == 11:
        nearer = np.abs(up - corner).sum(axis=-1) < np.abs(left - corner).sum(axis=-1)
        return np.where(nearer[..., None], left, up)
    if mode == 12:
        return np.clip(left + up - corner, 0, 255)
    half = mean(left, up)
    away = half - corner
    return np.clip(half + np.sign(away) * (np.abs(away) >> 1), 0, 255)


def _unpredict(rest: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    h, w, _ = rest.shape
    out = np.zeros((h, w, 4), np.int16)
    out[0] = np.cumsum(rest[0].astype(np.int64) + np.where(np.arange(w)[:, None] == 0, [255, 0, 0, 0], 0), axis=0) & 0xFF
    out[1:, 0] = np.cumsum(rest[1:, 0].astype(np.int64), axis=0) + out[0, 0] & 0xFF
    if w == 1 or h == 1:
        return out
    for wave in range(3, w + 2 * h - 2):  # x + 2 y
        y = np.arange(max(1, -(-(wave - w + 1) // 2)), min(h - 1, (wave - 1) // 2) + 1)
        x = wave - 2 * y
        if not len(y):
            continue
        left, up, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
        last = x == w - 1  # beyond the last column lies the first of the row below
        right = out[np.where(last, y, y - 1), np.where(last, 0, x + 1) % w]
        mode = modes[y >> tile, x >> tile]
        told = np.empty_like(left)
        for m in np.unique(mode).tolist():
            own = mode == m
            told[own] = predicted(left[own], up[own], right[own], corner[own], m if m < 14 else 0)
        out[y, x] = rest[y, x] + told & 0xFF
    return out


def _spread(values: np.ndarray, tile: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(values, 1 << tile, axis=0)[:h], 1 << tile, axis=1)[:, :w]


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32) >> 5


def lossless(chunk: bytes) -> np.ndarray:
    """height, width and channels r, g, b, a of a lossless chunk."""
    bits = Bits(chunk)
    if bits.read(8) != 0x2F:
        raise WebpError("no lossless image")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("an unknown version")
    undo, seen, width = [], set(), w
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform twice")
        seen.add(kind)
        if kind < 2:
            tile = bits.read(3) + 2
            undo.append((kind, tile, _entropy_image(bits, -(-width >> tile), -(-h >> tile), False), width))
        elif kind == 2:
            undo.append((kind, 0, None, width))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(_planes(_entropy_image(bits, size, 1, False)).astype(np.int64)[0], axis=0) & 0xFF
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, pack, table, width))
            width = -(-width >> pack)
    a = _planes(_entropy_image(bits, width, h, True))
    for kind, told, data, before in reversed(undo):
        if kind == 0:
            a = _unpredict(a, (data >> 8 & 0xFF).astype(np.int64), told)
        elif kind == 1:
            factors = [_spread(data >> s & 0xFF, told, h, before).astype(np.uint8) for s in (0, 8, 16)]  # green to red, green to blue, red to blue
            red = a[:, :, 1] + _delta(factors[0], a[:, :, 2].astype(np.uint8)) & 0xFF
            blue = a[:, :, 3] + _delta(factors[1], a[:, :, 2].astype(np.uint8)) + _delta(factors[2], red.astype(np.uint8)) & 0xFF
            a = np.stack([a[:, :, 0], red, a[:, :, 2], blue], axis=2).astype(np.int16)
        elif kind == 2:
            a[:, :, 1::2] = a[:, :, 1::2] + a[:, :, 2:3] & 0xFF
        else:
            x = np.arange(before)
            depth = 8 >> told
            index = a[:, x >> told, 2] >> (x & (1 << told) - 1) * depth & (1 << depth) - 1
            full = np.zeros((max(256, len(data)), 4), np.int16)
            full[: len(data)] = data
            a = full[index]
    return a[:, :, [1, 2, 3, 0]].astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels r, g, b of a lossless file. A lossy one is an error: its tables are not part of this library."""
    size = struct.unpack_from("<I", data, 4)[0]
    if len(data) < size + 8:
        raise WebpError("the file ends early")
    at = 12
    while at + 8 <= size + 8:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            if at + 8 + n > len(data):
                raise WebpError("the file ends early")
            return np.ascontiguousarray(lossless(data[at + 8 : at + 8 + n])[:, :, :3])
        if name in (b"VP8 ", b"ANMF"):
            raise WebpError("a lossy image" if name == b"VP8 " else "a moving image")
        at += 8 + n + (n & 1)
    raise WebpError("no image")
