"""Image headers and decoding by content: PNG (all forms), BMP, GIF, JPEG and lossless WebP in NumPy; lossy WebP by header.

A PNG or GIF that ends early keeps what was decoded and is marked; the rest has the format's first pixel. Files
of any JPEG form can be read by Spark's own image source (`jpeg_rasters`), which decodes in the JVM.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, webp

# Fixed values.
MAX_BYTES, MAX_PIXELS = 268_435_456, 1_431_655_764
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class ImageError(ValueError):
    pass


@dataclass
class Decoded:
    pixels: np.ndarray
    truncated: bool
    single: bool  # stored with one channel


def sniff(data: bytes) -> str | None:
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if data.startswith(b"\xff\xd8\xff"):
        return "jpg"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data.startswith(b"BM"):
        return "bmp"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header alone; null if there is none or the area is out of bounds."""
    try:
        found = _dimensions(data)
    except (struct.error, IndexError):
        return None
    return found if found and 0 < found[0] * found[1] <= MAX_PIXELS else None


def _dimensions(data: bytes) -> tuple[int, int] | None:
    kind = sniff(data)
    if kind == "png":
        return struct.unpack_from(">II", data, 16)
    if kind == "gif":
        return struct.unpack_from("<HH", data, 6)
    if kind == "bmp":
        w, h = struct.unpack_from("<ii", data, 18)
        return w, abs(h)
    if kind == "jpg":
        at = 2
        while at < len(data) - 8:
            if data[at] != 0xFF:
                return None
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return w, h
            else:
                at += 2 + (0 if 0xD0 <= mark <= 0xD9 or mark == 1 else struct.unpack_from(">H", data, at + 2)[0])
        return None
    if kind == "webp":
        form = data[12:16]
        if form == b"VP8 ":
            w, h = struct.unpack_from("<HH", data, 26)
            return w & 0x3FFF, h & 0x3FFF
        if form == b"VP8L":
            bits = struct.unpack_from("<I", data, 21)[0]
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if form == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    return None


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of a pass; missing ones stay 0."""
    out = np.zeros((h, stride), np.uint8)
    up = np.zeros(stride, np.uint8)
    for y in range(h):
        line = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        if len(line) < 2:
            break
        row = np.zeros(stride, np.uint8)
        part = np.frombuffer(line, np.uint8, offset=1)
        row[: len(part)] = part
        kind = line[0]
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row = row + up
        elif kind in (3, 4):
            values, above = row.tolist(), up.tolist()
            for x in range(stride):
                a, b = (values[x - step] if x >= step else 0), above[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[x - step] if x >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                values[x] = (values[x] + guess) & 255
            row = np.array(values, np.uint8)
        elif kind:
            raise ImageError("unknown row filter")
        row[len(part) :] = 0
        out[y] = up = row
    return out


def _samples(rows: np.ndarray, w: int, channels: int, depth: int) -> np.ndarray:
    if depth == 16:
        return rows.reshape(len(rows), -1, 2)[:, : w * channels, 0].reshape(len(rows), w, channels)  # the high byte
    if depth == 8:
        return rows[:, : w * channels].reshape(len(rows), w, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :w, None]


def _png(data: bytes) -> Decoded:
    head, palette, body, ended = None, None, [], False
    for name, chunk in _chunks(data):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk[: len(chunk) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            ended = True
    if head is None:
        raise ImageError("no header")
    w, h, depth, kind, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if channels is None or w * h == 0 or w * h > MAX_PIXELS:
        raise ImageError("bad header")
    stream, raw, broken = zlib.decompressobj(), b"", False
    try:
        raw = b"".join(stream.decompress(c) for c in body) + stream.flush()
    except zlib.error:
        stream, parts = zlib.decompressobj(), []
        for c in body:
            try:
                parts += [stream.decompress(c[i : i + 256]) for i in range(0, len(c), 256)]
            except zlib.error:
                break
        raw, broken = b"".join(parts), True
    out = np.zeros((h, w, channels), np.uint8)
    at = 0
    for x0, y0, dx, dy in ADAM7 if interlaced else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride = (pw * channels * depth + 7) // 8
        rows = _unfilter(raw[at : at + ph * (stride + 1)], ph, stride, max(1, channels * depth // 8))
        at += ph * (stride + 1)
        out[y0::dy, x0::dx] = _samples(rows, pw, channels, depth)
    truncated = broken or not ended or len(raw) < at
    if kind == 3:
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette) if palette is not None else 0] = palette if palette is not None else 0
        return Decoded(table[out[..., 0]], truncated, False)
    if depth < 8:
        out = (out.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return Decoded(out[..., 0], truncated, True) if channels <= 2 else Decoded(out[..., :3], truncated, False)


def _bmp(data: bytes) -> Decoded:
    start, = struct.unpack_from("<I", data, 10)
    head, w, h, _, depth, packed = struct.unpack_from("<IiiHHI", data, 14)
    if depth not in (8, 24, 32) or packed not in (0, 3) or w <= 0 or h == 0 or w * abs(h) > MAX_PIXELS:
        raise ImageError("unsupported bitmap")
    stride = (w * depth // 8 + 3) // 4 * 4
    body = data[start : start + stride * abs(h)]
    if len(body) < stride * abs(h):
        raise ImageError("the data ends early")
    rows = np.frombuffer(body, np.uint8).reshape(abs(h), stride)[:, : w * depth // 8]
    rows = rows[::-1] if h > 0 else rows
    if depth == 8:
        table = np.frombuffer(data[14 + head : start], np.uint8).reshape(-1, 4)[:, 2::-1]
        return Decoded(table[rows], False, False)
    return Decoded(rows.reshape(abs(h), w, depth // 8)[..., 2::-1], False, False)


def _gif(data: bytes) -> Decoded:
    w, h, flags, ground = struct.unpack_from("<HHBB", data, 6)
    at, table, clear = 13, None, None
    if flags & 128:
        n = 3 << ((flags & 7) + 1)
        table, at = data[at : at + n], at + n
    while at < len(data) and data[at] != 0x2C:
        if data[at] != 0x21:
            raise ImageError("no image")
        if data[at + 1] == 0xF9 and data[at + 3] & 1:
            clear = data[at + 6]
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    x0, y0, fw, fh, local = struct.unpack_from("<HHHHB", data, at + 1)
    at += 10
    if local & 128:
        n = 3 << ((local & 7) + 1)
        table, at = data[at : at + n], at + n
    if table is None:
        raise ImageError("no colours")
    low, at = data[at], at + 1
    body = bytearray()
    while at < len(data) and data[at]:
        body += data[at + 1 : at + 1 + data[at]]
        at += data[at] + 1
    ended = at < len(data)
    index = _lzw(bytes(body), low, fw * fh)
    truncated = len(index) < fw * fh or not ended
    frame = np.full(fw * fh, clear or 0, np.uint8)
    frame[: len(index)] = np.frombuffer(index, np.uint8)
    frame = frame.reshape(fh, fw)
    if local & 64:
        order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
        frame = frame[np.argsort(order)]
    colours = np.frombuffer(table[: len(table) // 3 * 3], np.uint8).reshape(-1, 3)
    colours = np.concatenate((colours, np.zeros((256 - len(colours), 3), np.uint8)))
    out = np.broadcast_to(colours[ground if flags & 128 else 0], (h, w, 3)).copy()
    out[y0 : y0 + fh, x0 : x0 + fw] = colours[frame][: h - y0, : w - x0]
    return Decoded(out, truncated, False)


def _lzw(body: bytes, low: int, most: int) -> bytes:
    clear, end = 1 << low, (1 << low) + 1
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    words, width, last = list(start), low + 1, None
    out, value, bits = bytearray(), 0, 0
    for byte in body:
        value |= byte << bits
        bits += 8
        while bits >= width:
            code, value, bits = value & (1 << width) - 1, value >> width, bits - width
            if code == clear:
                words, width, last = list(start), low + 1, None
                continue
            if code == end or len(out) >= most:
                return bytes(out[:most])
            if last is None:
                word = words[code] if code < len(words) else b""
            elif code < len(words):
                word = words[code]
                words.append(last + word[:1])
            else:
                word = last + last[:1]
                words.append(word)
            out += word
            last = word
            if len(words) == 1 << width and width < 12:
                width += 1
    return bytes(out[:most])


def _jpeg(data: bytes) -> Decoded:
    a = jpeg.decode(data)
    return Decoded(a, False, a.ndim == 2)


def _webp(data: bytes) -> Decoded:
    return Decoded(webp.decode(data), False, False)


def decode(data: bytes) -> Decoded:
    kind = sniff(data)
    reader = {"png": _png, "bmp": _bmp, "gif": _gif, "jpg": _jpeg, "webp": _webp}.get(kind or "")
    if reader is None:
        raise ImageError(f"unsupported image: {kind or 'unknown'}")
    try:
        return reader(data)
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise e if isinstance(e, ImageError) else ImageError(str(e)) from e


def jpeg_rasters(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, width, height, channels and data (RGB or gray rows) of the JPEG files below a path, decoded in the JVM."""
    i = F.col("image")
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(path)
    return rows.where(i["width"] > 0).select(i["origin"].alias("rel_path"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("bgr")).mapInPandas(_to_rgb, "rel_path string, width int, height int, channels int, data binary")


def _to_rgb(batches):
    for b in batches:
        b["data"] = [np.frombuffer(d, np.uint8).reshape(-1, c)[:, : 3 if c >= 3 else 1][:, ::-1].tobytes() for d, c in zip(b.pop("bgr"), b["channels"], strict=True)]
        b["channels"] = b["channels"].clip(upper=3)
        yield b[["rel_path", "width", "height", "channels", "data"]]
