"""Lossless WebP against a plain encoder: every transform, all predictors, references, cache, groups of codes."""

import struct

import numpy as np
import pytest

from folioloom.sources import images, webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


class Flat:
    """A complete code that gives every symbol of an alphabet one of two neighbouring lengths."""

    def __init__(self, alphabet):
        n = max(1, (alphabet - 1).bit_length())
        short = (1 << n) - alphabet
        self.lengths = [n - 1] * short + [n] * (alphabet - short)
        if alphabet > 1 and n - 1 == 0:
            self.lengths = [1, 1]
        code, self.codes = 0, {}
        for length in sorted(set(self.lengths)):
            code <<= length - (last if self.codes else length)  # noqa: F821
            for s, k in enumerate(self.lengths):
                if k == length:
                    self.codes[s] = (code, length)
                    code += 1
            last = length

    def define(self, w):
        """Lengths, each written by a flat code for lengths over 0 to 15 (4 bits each)."""
        w.put(0, 1)
        order = webp.LENGTH_ORDER
        w.put(len(order) - 4, 4)
        for s in order:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for n in self.lengths:
            w.put(int(f"{n:04b}"[::-1], 2), 4)

    def put(self, w, s):
        code, n = self.codes[s]
        w.put(int(f"{code:0{n}b}"[::-1], 2), n)


def _prefix(w, value, code):
    """A length or distance by its prefix symbol."""
    v = value - 1
    if v < 4:
        code.put(w, v if code.first is None else code.first + v)
        return
    top = v.bit_length() - 1
    symbol = 2 * top + (v >> (top - 1) & 1)
    code.put(w, symbol if code.first is None else code.first + symbol)
    w.put(v & (1 << (top - 1)) - 1, top - 1)


def _image(w, pixels, top=False, cache=0, groups=None, rng=None, repeats=False):
    """Pixels 0xAARRGGBB; groups: (tile bits, group of each tile)."""
    h, width = pixels.shape
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    if top:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(groups[0] - 2, 3)
            _image(w, groups[1].astype(np.uint32) << 8)
    count = int(groups[1].max()) + 1 if groups is not None else 1
    codes = []
    for _ in range(count):
        own = [Flat(n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]
        for c in own:
            c.define(w)
        own[0].first, own[4].first = 256, None
        codes.append(own)
    flat, held, n = pixels.ravel().tolist(), [0] * (1 << cache), 0
    slot = lambda p: (p * webp.SPREAD & 0xFFFFFFFF) >> 32 - cache
    while n < len(flat):
        y, x = divmod(n, width)
        g, r, b, a, d = codes[groups[1][y >> groups[0], x >> groups[0]] if groups is not None else 0]
        found = 0
        if repeats and n:
            code = int(rng.integers(1, 140))
            back = code - 120 if code > 120 else max(1, webp.NEAR[code - 1][0] + webp.NEAR[code - 1][1] * width)
            while back <= n and n + found < len(flat) and flat[n + found] == flat[n + found - back] and found < 5000:
                found += 1
        if found > 1:
            _prefix(w, found, g)
            _prefix(w, code, d)
        elif cache and held[slot(flat[n])] == flat[n] and n:
            g.put(w, 280 + slot(flat[n]))
            found = 1
        else:
            p, found = flat[n], 1
            for code, s in ((g, p >> 8), (r, p >> 16), (b, p), (a, p >> 24)):
                code.put(w, s & 255)
        for p in flat[n : n + found]:
            if cache:
                held[slot(p)] = p
        n += found


def _file(w, width, height, body):
    head = Writer()
    head.put(0x2F, 8)
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(1, 1)
    head.put(0, 3)
    head.bits += w.bits
    chunk = head.data()
    chunk += b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk


def _packed(a):
    return (a[..., 3].astype(np.uint32) << 24) | (a[..., 0].astype(np.uint32) << 16) | (a[..., 1].astype(np.uint32) << 8) | a[..., 2]


def _pixels(seed, h, w, smooth=True):
    rng = np.random.default_rng(seed)
    a = np.cumsum(rng.integers(-3, 4, (h, w, 4)), axis=1) + np.cumsum(rng.integers(-3, 4, (h, 1, 4)), axis=0) + 100 if smooth else rng.integers(0, 3, (h, w, 4)) * 90
    return np.clip(a, 0, 255).astype(np.uint8)


def _predict(a, modes, tile):
    """Residuals pixel by pixel, channels a, r, g, b, by the plain rules."""
    h, w, _ = a.shape
    out = np.zeros_like(a, dtype=np.int64)
    a = a.astype(int)
    for y in range(h):
        for x in range(w):
            at = lambda yy, xx: a[yy, xx]
            if y == 0 and x == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = at(0, x - 1)
            elif x == 0:
                p = at(y - 1, 0)
            else:
                left, up, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
                right = at(y - 1, x + 1) if x + 1 < w else at(y, 0)
                m = modes[y >> tile, x >> tile]
                half = (left + up) // 2
                away = half - corner
                p = [np.array([255, 0, 0, 0]), left, up, right, corner, ((left + right) // 2 + up) // 2, (left + corner) // 2, half, (corner + up) // 2, (up + right) // 2, ((left + corner) // 2 + (up + right) // 2) // 2,
                     left if sum(abs(left + up - corner - left)) < sum(abs(left + up - corner - up)) else up, np.clip(left + up - corner, 0, 255), np.clip(half + np.array([int(v / 2) for v in away]), 0, 255)][m]
            out[y, x] = (a[y, x] - p) % 256
    return out


def _argb(planes):
    return (planes[..., 0].astype(np.uint32) << 24) | (planes[..., 1].astype(np.uint32) << 16) | (planes[..., 2].astype(np.uint32) << 8) | planes[..., 3].astype(np.uint32)


@pytest.mark.parametrize("cache", [0, 3, 11])
@pytest.mark.parametrize("repeats", [False, True])
def test_symbols(cache, repeats):
    rng = np.random.default_rng(cache)
    a = _pixels(cache, 23, 31, smooth=False)
    a[5:20] = a[4]
    groups = (2, rng.integers(0, 3, (6, 8)))
    for g in (None, groups):
        w = Writer()
        w.put(0, 1)
        _image(w, _packed(a), True, cache, g, rng, repeats)
        assert (webp.decode(_file(w, 31, 23, a)) == a[..., :3]).all()


@pytest.mark.parametrize("tile", [2, 3])
def test_predictors(tile):
    a = _pixels(tile, 33, 29)
    planes = a[..., [3, 0, 1, 2]]
    modes = np.random.default_rng(tile).permutation(np.arange(-(-33 >> tile) * -(-29 >> tile)) % 14).reshape(-(-33 >> tile), -(-29 >> tile))
    w = Writer()
    w.put(1, 1)
    w.put(0, 2)
    w.put(tile - 2, 3)
    _image(w, modes.astype(np.uint32) << 8)
    w.put(0, 1)
    _image(w, _argb(_predict(planes, modes, tile)), True)
    assert (webp.decode(_file(w, 29, 33, a)) == a[..., :3]).all()


def test_colour_transforms():
    a = _pixels(9, 21, 18)
    r, g, b = (a[..., i].astype(int) for i in range(3))
    signed = lambda v: (v + 128) % 256 - 128
    rng = np.random.default_rng(0)
    f = rng.integers(0, 256, (3, 6, 5))
    wide = [np.repeat(np.repeat(x, 4, 0)[:21], 4, 1)[:, :18] for x in f]
    green_less = (r - g) % 256, (b - g) % 256  # applied first, undone last
    red = (green_less[0] - (signed(wide[0]) * signed(g) >> 5)) % 256
    blue = (green_less[1] - (signed(wide[1]) * signed(g) >> 5) - (signed(wide[2]) * signed(green_less[0]) >> 5)) % 256
    w = Writer()
    w.put(1, 1)
    w.put(2, 2)
    w.put(1, 1)
    w.put(1, 2)
    w.put(0, 3)
    _image(w, (f[0] | f[1] << 8 | f[2] << 16 | 255 << 24).astype(np.uint32))
    w.put(0, 1)
    _image(w, _argb(np.stack([a[..., 3], red, g, blue], axis=2)), True)
    assert (webp.decode(_file(w, 18, 21, a)) == a[..., :3]).all()


@pytest.mark.parametrize("size", [1, 2, 4, 16, 17, 256])
def test_palettes(size):
    rng = np.random.default_rng(size)
    table = rng.integers(0, 256, (size, 4)).astype(np.uint8)
    index = rng.integers(0, size, (13, 27))
    pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    packed = np.zeros((13, -(-27 >> pack)), int)
    for x in range(27):
        packed[:, x >> pack] |= index[:, x] << (x & (1 << pack) - 1) * (8 >> pack)
    steps = np.diff(table.astype(int), axis=0, prepend=0) % 256
    w = Writer()
    w.put(1, 1)
    w.put(3, 2)
    w.put(size - 1, 8)
    _image(w, _packed(steps[None]))
    w.put(0, 1)
    _image(w, packed.astype(np.uint32) << 8, True, repeats=True, rng=rng)
    assert (webp.decode(_file(w, 27, 13, None)) == table[index][..., :3]).all()


def test_short_codes_and_flat_images():
    w = Writer()
    w.put(0, 1)
    w.put(0, 1)
    w.put(0, 1)
    for wide, symbol in ((1, 77), (1, 200), (0, 1), (1, 255), (0, 0)):  # one symbol each, no bits for pixels
        w.put(1, 1)
        w.put(0, 1)
        w.put(wide, 1)
        w.put(symbol, 8 if wide else 1)
    a = webp.decode(_file(w, 6, 5, None))
    assert a.shape == (5, 6, 3) and (a == [200, 77, 1]).all()


def test_damaged_files_are_errors():
    a = _pixels(3, 20, 20)
    w = Writer()
    w.put(0, 1)
    _image(w, _packed(a), True)
    data = _file(w, 20, 20, a)
    assert images.decode(data).pixels.shape == (20, 20, 3) and images.dimensions(data) == (20, 20)
    rng = np.random.default_rng(1)
    for cut in (13, 20, 25, len(data) // 2, len(data) - 2):
        with pytest.raises(images.ImageError):
            images.decode(data[:cut])
        short = data[:4] + struct.pack("<I", max(12, cut - 8)) + data[8:16] + struct.pack("<I", max(0, cut - 20)) + data[20:cut]
        with pytest.raises(images.ImageError):
            images.decode(short)
    for _ in range(60):
        spoilt = bytearray(data)
        spoilt[int(rng.integers(20, len(data)))] ^= int(rng.integers(1, 256))
        try:
            images.decode(bytes(spoilt))
        except images.ImageError:
            pass
    with pytest.raises(images.ImageError, match="lossy"):
        images.decode(b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8 " + struct.pack("<I", 10) + b"\0" * 10)
