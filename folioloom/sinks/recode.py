"""JPEG files made smaller without loss: the same coefficients, with Huffman tables made for them."""

from __future__ import annotations

import struct

from folioloom.sources import jpeg

from .images import entropy


def recode(data: bytes) -> bytes:
    """The image with tables of its own; the bytes given if they are no plain sequential image, or if nothing is gained."""
    try:
        told = jpeg.read(data)
    except (ValueError, KeyError, IndexError, struct.error):
        return data
    if told.progressive or told.interval or told.scans != 1 or len(told.frame) not in (1, 3):
        return data
    rows, columns = told.groups
    units = [c.grid.reshape(rows, c.down, columns, c.across, 64).transpose(0, 2, 1, 3, 4).reshape(rows * columns, c.down * c.across, 64) for c in told.frame]
    huffman, scan = entropy(units)
    out, at = bytearray(data[:2]), 2
    while True:  # every other segment stays as it is
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        segment = data[at : at + 2 + n]
        at += 2 + n
        if mark == 0xDA:
            k = segment[4]
            names = b"".join(bytes([segment[5 + 2 * i], 0x11 * min(i, 1)]) for i in range(k))
            out += b"\xff\xc4" + struct.pack(">H", len(huffman) + 2) + huffman + segment[:5] + names + segment[5 + 2 * k :]
            break
        if mark != 0xC4:
            out += segment
    out += scan + b"\xff\xd9"
    return bytes(out) if len(out) < len(data) else data
