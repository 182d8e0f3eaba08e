"""JPEG decoding in NumPy: Huffman-coded 8-bit images of one, three or four components, sequential or progressive.

Of sequential scans the entropy decoding walks from code to code over tables made for all bits at once; progressive
scans, whose later ones refine single bits, are read code by code. The inverse transform (in whole numbers), smooth
upsampling and colour are done on whole planes.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

from folioloom.sinks.images import ZIGZAG


class JpegError(ValueError):
    pass


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: length and symbol of the code they begin with (length 0: none)."""
    table, at, first = np.zeros((65_536, 2), np.uint8), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            table[first : first + (1 << (16 - length))] = length, s
            first += 1 << (16 - length)
        at += n
    return table


class _Bits:
    """A part of a scan between restart markers: what a code at each bit would be."""

    def __init__(self, segment: bytes):
        self.data = np.frombuffer(segment.replace(b"\xff\x00", b"\xff") + bytes(16), np.uint8)
        self.size = 8 * (len(self.data) - 16)

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The 16 bits from each place on."""
        i, d = at >> 3, self.data
        i = np.minimum(i, len(d) - 4)
        three = d[i].astype(np.int64) << 16 | d[i + 1].astype(np.int64) << 8 | d[i + 2]
        return three >> (8 - (at & 7)) & 0xFFFF

    def everywhere(self, *tables: np.ndarray) -> list[bytes]:
        """Each table's entry for the 16 bits from every place on."""
        out: list[list[bytes]] = [[] for _ in tables]
        for a in range(0, len(self.data) - 3, 1 << 16):
            d = self.data[a : a + (1 << 16) + 3].astype(np.int32)
            three = d[:-3] << 16 | d[1:-2] << 8 | d[2:-1]
            window = (three[:, None] >> (8 - np.arange(8)) & 0xFFFF).ravel()
            for o, t in zip(out, tables, strict=True):
                o.append(t[window].tobytes())
        return [b"".join(o) for o in out]

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Signed numbers of n bits at the places."""
        v = self.windows(at) >> (16 - n)
        return np.where((n > 0) & (v < 1 << np.maximum(n - 1, 0)), v - (1 << n) + 1, v)


#: Steps of a block's place that mark its end and an unknown code; more than any run.
ENDS, UNKNOWN = 128, 255


def _blocks(segment: bytes, plan: list[tuple[int, np.ndarray, np.ndarray]], units: int, kinds: int) -> tuple[list[np.ndarray], ...]:
    """Of `units` groups, for each component: DC values, and block, place and value of the others. plan: component and its two tables, block by block.

    How far a code and its bits reach is looked up at every bit at once; a lean loop then walks from code to code.
    """
    bits = _Bits(segment)
    reach: dict[int, tuple[bytes, bytes]] = {}
    for _, dc, ac in plan:
        if id(dc) not in reach:
            reach[id(dc)] = (bits.everywhere(dc[:, 0] + dc[:, 1])[0], b"")
        if id(ac) not in reach:
            run, n = ac[:, 1] >> 4, ac[:, 1] & 15
            step = np.where(n > 0, run + 1, np.where(run == 15, 16, ENDS))
            reach[id(ac)] = tuple(bits.everywhere(ac[:, 0] + n, np.where(ac[:, 0] > 0, step, UNKNOWN).astype(np.uint8)))
    walk = [(reach[id(dc)][0], *reach[id(ac)]) for _, dc, ac in plan]
    at, starts, codes, ends = 0, [], [], []
    note = codes.append
    try:
        for _ in range(units):
            for dc_reach, ac_reach, ac_step in walk:
                starts.append(at)
                at += dc_reach[at]
                k = 1
                while k < 64:
                    note(at)
                    k += ac_step[at]
                    at += ac_reach[at]
                ends.append(len(codes))
    except IndexError:
        raise JpegError("the data ends early") from None
    if at > bits.size + 7 * 8:
        raise JpegError("the data ends early")
    starts, codes, ends = (np.array(x, dtype=np.int64) for x in (starts, codes, ends))
    of = np.tile([c for c, _, _ in plan], units)
    block = np.repeat(np.arange(len(starts)), np.diff(ends, prepend=0))
    out: tuple[list[np.ndarray], ...] = ([], [], [], [])
    for c in range(kinds):
        _, dc, ac = next(p for p in plan if p[0] == c)
        mine = of == c
        length, n = dc[bits.windows(starts[mine])].T.astype(np.int64)
        if not length.all() or n.max(initial=0) > 15:
            raise JpegError("a code is unknown")
        out[0].append(np.cumsum(bits.values(starts[mine] + length, n)))
        number = np.cumsum(mine) - 1
        own = mine[block]
        at_code, of_block = codes[own], number[block[own]]
        length, symbol = ac[bits.windows(at_code)].T.astype(np.int64)
        if not length.all():
            raise JpegError("a code is unknown")
        n, run = symbol & 15, symbol >> 4
        step = np.where(n > 0, run + 1, np.where(run == 15, 16, 0))
        total = np.cumsum(step)
        head = np.flatnonzero(np.diff(of_block, prepend=-1))
        k = total - np.repeat(total[head] - step[head], np.diff(np.append(head, len(step)))) if len(step) else total
        if k.max(initial=0) > 63 and ((k > 63) & (n > 0)).any():
            raise JpegError("a block is too long")
        there = n > 0
        out[1].append(of_block[there])
        out[2].append(k[there])
        out[3].append(bits.values(at_code + length, n)[there])
    return out


def _double(p: np.ndarray, both: bool) -> np.ndarray:
    """Twice as wide, and as tall if `both`: three parts of the nearer sample and one of the next."""
    p = p.astype(np.int64)
    edge = lambda a, axis: (np.concatenate((a.take([0], axis), a.take(range(a.shape[axis] - 1), axis)), axis), np.concatenate((a.take(range(1, a.shape[axis]), axis), a.take([-1], axis)), axis))
    if both:
        up, down = edge(p, 0)
        rows = np.empty((2 * p.shape[0], p.shape[1]), np.int64)
        rows[::2], rows[1::2] = 3 * p + up, 3 * p + down
        left, right = edge(rows, 1)
        out = np.empty((rows.shape[0], 2 * rows.shape[1]), np.int64)
        out[:, ::2], out[:, 1::2] = (3 * rows + left + 8) >> 4, (3 * rows + right + 7) >> 4
        return out
    left, right = edge(p, 1)
    out = np.empty((p.shape[0], 2 * p.shape[1]), np.int64)
    out[:, ::2], out[:, 1::2] = (3 * p + left + 1) >> 2, (3 * p + right + 2) >> 2
    return out


class _Reader(_Bits):
    """A part of a progressive scan, read code by code."""

    def __init__(self, segment: bytes, table: np.ndarray | None):
        super().__init__(segment)
        self.raw = self.data.tobytes()
        self.at = 0
        if table is not None:
            self.length, self.symbol = self.everywhere(np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1]))

    def code(self) -> int:
        n = self.length[self.at]
        if not n:
            raise JpegError("a code is unknown")
        s = self.symbol[self.at]
        self.at += n
        return s

    def bits(self, n: int) -> int:
        if not n:
            return 0
        i = self.at >> 3
        v = int.from_bytes(self.raw[i : i + 4], "big") >> (32 - (self.at & 7) - n) & (1 << n) - 1
        self.at += n
        return v


def _first_pass(reader: _Reader, blocks: list[list[int]], first: int, last: int, low: int) -> None:
    """Coefficients first..last of blocks, all but their `low` lowest bits."""
    idle = 0
    for block in blocks:
        if idle:
            idle -= 1
            continue
        k = first
        while k <= last:
            s = reader.code()
            run, n = s >> 4, s & 15
            if n:
                k += run
                if k > 63:
                    raise JpegError("a block is too long")
                v = reader.bits(n)
                block[k] = (v if v >> (n - 1) else v - (1 << n) + 1) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                idle = (1 << run) - 1 + reader.bits(run)
                break


def _next_pass(reader: _Reader, blocks: list[list[int]], first: int, last: int, low: int) -> None:
    """One more bit, the `low`th, of coefficients first..last: known ones get a bit each, new ones come with their sign."""
    one, idle = 1 << low, 0

    def refine(block: list[int], k: int) -> None:
        if reader.bits(1) and not abs(block[k]) & one:
            block[k] += one if block[k] > 0 else -one

    for block in blocks:
        k = first
        while k <= last and not idle:
            s = reader.code()
            run, n = s >> 4, s & 15
            if not n and run < 15:
                idle = (1 << run) + reader.bits(run)
                break
            new = (one if reader.bits(1) else -one) if n else 0
            while k <= last:
                if block[k]:
                    refine(block, k)
                elif run:
                    run -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if idle:
            for k in range(k, last + 1):
                if block[k]:
                    refine(block, k)
            idle -= 1


# Rotations of the fast eight-point transform in parts of 8,192.
EVEN = {"both": 4_433, "second": 6_270, "sixth": -15_137}
ODD = {"all": 9_633, "1": 12_299, "3": 25_172, "5": 16_819, "7": 2_446, "17": -7_373, "35": -20_995, "37": -16_069, "15": -3_196}


def _transform() -> np.ndarray:
    """One pass of the inverse transform as a matrix of whole numbers (outputs x coefficients), from the rotations."""
    x = np.eye(8, dtype=np.int64)
    turn = EVEN["both"] * (x[2] + x[6])
    outer, inner = turn + EVEN["second"] * x[2], turn + EVEN["sixth"] * x[6]
    even = np.stack(((x[0] + x[4] << 13) + outer, (x[0] - x[4] << 13) + inner, (x[0] - x[4] << 13) - inner, (x[0] + x[4] << 13) - outer))
    every = ODD["all"] * (x[1] + x[3] + x[5] + x[7])
    pair = {k: ODD[k] * (x[int(k[0])] + x[int(k[1])]) for k in ("17", "35", "37", "15")}
    own = {k: ODD[k] * x[int(k)] for k in "1357"}
    # Each odd coefficient's output has its own term and those of the two pairs it is in.
    odd = np.stack([own[k] + every + sum(v for name, v in pair.items() if k in name) for k in "1357"])
    return np.concatenate((even + odd, (even - odd)[::-1]))


PASS = _transform()


def _samples(blocks: np.ndarray) -> np.ndarray:
    """8 x 8 samples from 8 x 8 coefficients, by columns and then by rows; each pass ends with a rounded shift."""
    columns = np.matmul(PASS.astype(np.float64), blocks).astype(np.int64) + 1024 >> 11  # exact: far below 2^53
    rows = np.matmul(columns.astype(np.float64), PASS.T.astype(np.float64)).astype(np.int64) + 131_072 >> 18
    return np.clip(rows + 128, 0, 255)


@dataclass
class _Component:
    name: int
    across: int  # sampling
    down: int
    quantiser: int
    grid: np.ndarray  # coefficients, rows x columns of blocks x 64, in the order of the file
    seen: tuple[int, int]  # rows and columns of blocks that a scan of its own has


def _scan(parts: list[bytes], own: list[tuple[_Component, np.ndarray | None, np.ndarray | None]], shape: tuple[int, int], spectrum: tuple[int, int, int, int], interval: int, progressive: bool) -> None:
    """Reads a scan into the grids of its components. shape: rows and columns of groups of all components."""
    if len(own) == 1:  # blocks in rows, without those that only fill groups up
        c = own[0][0]
        places = [(np.arange(c.seen[0])[:, None] * c.grid.shape[1] + np.arange(c.seen[1])).reshape(-1, 1)]
    else:
        places = []
        for c, _, _ in own:
            at = np.arange(c.grid.shape[0] * c.grid.shape[1]).reshape(shape[0], c.down, shape[1], c.across)
            places.append(at.transpose(0, 2, 1, 3).reshape(shape[0] * shape[1], -1))
    left, done = len(places[0]), 0
    first, last, high, low = spectrum
    for part in parts:
        units = min(left, interval or left)
        if not units:
            break
        here = [p[done : done + units] for p in places]
        flat = [c.grid.reshape(-1, 64) for c, _, _ in own]
        if not progressive:
            plan = [(i, dc, ac) for i, ((_, dc, ac), p) in enumerate(zip(own, here, strict=True)) for _ in range(p.shape[1])]
            for grid, at, dc, block, place, value in zip(flat, here, *_blocks(part, plan, units, len(own)), strict=True):
                grid[at.ravel(), 0] = dc
                grid[at.ravel()[block], place] = value
        elif first:
            c, _, ac = own[0]
            reader = _Reader(part, ac)
            at = here[0].ravel()
            blocks = flat[0][at].tolist()
            (_next_pass if high else _first_pass)(reader, blocks, first, last, low)
            flat[0][at] = blocks
        elif high:
            bits = np.unpackbits(_Bits(part).data)
            order = np.concatenate([p + (i << 40) for i, p in enumerate(here)], axis=1).ravel()
            for i, grid in enumerate(flat):
                mine = order >> 40 == i
                grid[order[mine] & (1 << 40) - 1, 0] += bits[: len(order)][mine].astype(np.int64) << low
        else:
            none = np.tile(np.array([[1, 0]], np.uint8), (65_536, 1))
            _dc_first(part, [(i, dc, none) for i, ((_, dc, _), p) in enumerate(zip(own, here, strict=True)) for _ in range(p.shape[1])], units, flat, here, low)
        left, done = left - units, done + units
    if left:
        raise JpegError("the data ends early")


def _dc_first(part: bytes, plan: list[tuple], units: int, grids: list[np.ndarray], here: list[np.ndarray], low: int) -> None:
    bits = _Bits(part)
    reach = {id(dc): bits.everywhere(dc[:, 0] + dc[:, 1])[0] for _, dc, _ in plan}
    walk = [reach[id(dc)] for _, dc, _ in plan]
    at, starts = 0, []
    try:
        for _ in range(units):
            for r in walk:
                starts.append(at)
                at += r[at]
    except IndexError:
        raise JpegError("the data ends early") from None
    starts, of = np.array(starts, dtype=np.int64), np.tile([c for c, _, _ in plan], units)
    for i, (grid, places) in enumerate(zip(grids, here, strict=True)):
        dc = next(d for c, d, _ in plan if c == i)
        length, n = dc[bits.windows(starts[of == i])].T.astype(np.int64)
        if not length.all():
            raise JpegError("a code is unknown")
        grid[places.ravel(), 0] = np.cumsum(bits.values(starts[of == i] + length, n)) << low


@dataclass
class Read:
    frame: list[_Component]
    quant: dict[int, np.ndarray]
    width: int
    height: int
    groups: tuple[int, int]  # rows and columns of groups of all components
    adobe: int | None
    progressive: bool
    scans: int
    interval: int  # groups between restart markers


def read(data: bytes) -> Read:
    """The coefficients of all components."""
    quant: dict[int, np.ndarray] = {}
    huffman: dict[tuple[int, int], np.ndarray] = {}
    frame: list[_Component] = []
    w = h = interval = 0
    adobe, progressive, shape, scans = None, False, (0, 0), 0
    at = 2
    while True:
        if at + 4 > len(data):
            if scans and progressive:  # every scan makes the whole finer
                break
            raise JpegError("the data ends early")
        if data[at] != 0xFF:
            raise JpegError("the data ends early")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                quant[body[0] & 15] = values
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, h, w, k = struct.unpack_from(">BHHB", body)
            if depth != 8 or k not in (1, 3, 4) or not w * h or frame:
                raise JpegError("unsupported form")
            progressive = mark == 0xC2
            told = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            if len(told) == 1:
                told = [(told[0][0], 1, 1, told[0][3])]
            most_h, most_v = max(t[1] for t in told), max(t[2] for t in told)
            shape = -(-h // (8 * most_v)), -(-w // (8 * most_h))
            for name, across, down, q in told:
                seen = -(-(-(-h * down // most_v)) // 8), -(-(-(-w * across // most_h)) // 8)
                frame.append(_Component(name, across, down, q, np.zeros((shape[0] * down, shape[1] * across, 64), np.int64), seen))
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise JpegError("arithmetic or lossless coding")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif mark == 0xEE and body.startswith(b"Adobe"):
            adobe = body[11]
        at += 2 + n
        if mark != 0xDA:
            continue
        end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
        if end is None:
            if scans and progressive:
                break
            raise JpegError("the data ends early")
        names = [body[1 + 2 * i] for i in range(body[0])]
        tables = [body[2 + 2 * i] for i in range(body[0])]
        first, last, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        by_name = {c.name: c for c in frame}
        own = [(by_name[name], huffman.get((0, t >> 4)), huffman.get((1, t & 15))) for name, t in zip(names, tables, strict=True)]
        if any((dc is None and not (progressive and (first or bits >> 4))) or (ac is None and (not progressive or first)) for _, dc, ac in own):
            raise JpegError("a table is missing")
        parts = re.split(rb"\xff[\xd0-\xd7]", data[at : end.start()])
        _scan(parts, own, shape, (first, last, bits >> 4, bits & 15), interval, progressive)
        scans += 1
        at = end.start()
        if not progressive and scans == len(frame) or not progressive and len(own) == len(frame):
            break
    if not scans or not progressive and not all(c.grid.any() or c.quantiser in quant for c in frame):
        raise JpegError("the data ends early")
    return Read(frame, quant, w, h, shape, adobe, progressive, scans, interval)


def decode(data: bytes) -> np.ndarray:
    """Gray or RGB samples."""
    told = read(data)
    frame, quant, w, h, adobe = told.frame, told.quant, told.width, told.height, told.adobe
    most_h, most_v = max(c.across for c in frame), max(c.down for c in frame)
    zigzag, planes = np.array(ZIGZAG), []
    for c in frame:
        own = np.zeros(c.grid.shape)
        own[..., zigzag] = c.grid * quant[c.quantiser]
        rows, columns = c.grid.shape[:2]
        p = _samples(own.reshape(-1, 8, 8))
        p = p.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        p = p[: -(-h * c.down // most_v), : -(-w * c.across // most_h)]
        if (most_h // c.across, most_v // c.down) in ((2, 1), (2, 2)):
            p = _double(p, most_v // c.down == 2)
        else:
            p = np.repeat(np.repeat(p, most_v // c.down, 0), most_h // c.across, 1)
        planes.append(p[:h, :w].astype(np.int64))
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    if len(planes) == 3 and adobe == 0 or len(planes) == 4 and adobe != 2:
        colour = np.stack(planes[:3], -1)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = (y + ((91_881 * cr + 32_768) >> 16), y + ((-22_554 * cb - 46_802 * cr + 32_768) >> 16), y + ((116_130 * cb + 32_768) >> 16))
        colour = np.clip(np.stack(rgb, -1), 0, 255)
    if len(planes) == 4:  # inks: with Adobe's mark they are stored as what they leave
        ink = planes[3][..., None]
        if adobe is None:
            colour, ink = 255 - colour, 255 - ink
        colour = (colour * ink + 127) // 255
    return colour.astype(np.uint8)
