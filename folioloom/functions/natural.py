"""Natural order of names and paths as a sort key: a column of JVM expressions, and the same key of a single path for code inside tasks.

A name is cut into a stem and up to two short extensions; each is a row of texts and numbers, which starts with a text.
Texts are lower-case; numbers are compared by value, whatever their size, script or leading zeros; a digit that has no
decimal value (a superscript, a circled one) is a number by itself. In a path, a file comes before a folder.

Digits are those of Unicode 16, whatever version the interpreter or the JVM has, so two clusters agree on an order.

The key of a path is, for each part between slashes, a mark (0 for the last, a file; 1 for a folder), its pieces, each with a 0 after
it, and a 0. A text ends with a 1; a number is a 1, a 4 for each digit, a 3, and its digits. Characters up to 5 stand as two. A null path has a null key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (Unicode 16): code points of the zeros of all decimal digits, ten of which follow each other.
ZEROS = (
    0x30, 0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xDE6, 0xE50, 0xED0, 0xF20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90,
    0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10, 0x104A0, 0x10D30, 0x10D40, 0x11066, 0x110F0, 0x11136, 0x111D0, 0x112F0, 0x11450,
    0x114D0, 0x11650, 0x116C0, 0x116D0, 0x116DA, 0x11730, 0x118E0, 0x11950, 0x11BF0, 0x11C50, 0x11D50, 0x11DA0, 0x11F50, 0x16130, 0x16A60, 0x16AC0, 0x16B50, 0x16D70, 0x1CCF0, 0x1D7CE,
    0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6, 0x1E140, 0x1E2F0, 0x1E4F0, 0x1E5F1, 0x1E950, 0x1FBF0,
)
# Fixed values (Unicode 16): first and last code point and first value of digits that have no decimal value.
SINGLES = (
    (0xB2, 0xB3, 2), (0xB9, 0xB9, 1), (0x1369, 0x1371, 1), (0x19DA, 0x19DA, 1), (0x2070, 0x2070, 0), (0x2074, 0x2079, 4), (0x2080, 0x2089, 0), (0x2460, 0x2468, 1), (0x2474, 0x247C, 1),
    (0x2488, 0x2490, 1), (0x24EA, 0x24EA, 0), (0x24F5, 0x24FD, 1), (0x24FF, 0x24FF, 0), (0x2776, 0x277E, 1), (0x2780, 0x2788, 1), (0x278A, 0x2792, 1), (0x10A40, 0x10A43, 1),
    (0x10E60, 0x10E68, 1), (0x11052, 0x1105A, 1), (0x1F100, 0x1F100, 0), (0x1F101, 0x1F10A, 0),
)

DECIMALS = {chr(z + i): str(i) for z in ZEROS for i in range(10)}
ALONE = {chr(c): str(v + c - a) for a, b, v in SINGLES for c in range(a, b + 1)}
_CLASS = "".join(f"{chr(z)}-{chr(z + 9)}" for z in ZEROS)
_ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in SINGLES)

#: What its group holds are a name's extensions. Patterns mean the same to Python and to Java.
EXTENSIONS = rf"\A\.*[^.][\s\S]*?((?:\.(?![{_CLASS}])[^.]{{0,4}}){{0,2}})(?![\s\S])"
ESCAPES = (("\x05", "\x05\x15"), *((chr(i), f"\x05{chr(0x10 + i)}") for i in range(5)))
#: From pieces with their ends to keys, once decimal digits are ASCII: (pattern, replacement with $1 for the group).
AROUND = (f"([{_ALONE}])", "\x02$1\x02")
STEPS = (
    (r"(?<![0-9])0+(?=[0-9])", ""),
    ("(?<=[^0-9\x00-\x04])(?=\x00)", "\x01"),
    ("([0-9]+)", "\x01\x01$1\x03$1"),
    ("[0-9](?=[0-9]*\x03)", "\x04"),
    ("\x02", ""),
)


def extensions(name: str) -> tuple[str, list[str]]:
    """Stem and extensions: at most two, of up to five characters with the dot, not starting with a decimal digit; leading dots belong to the stem.

    What the extensions are together is taken out of the name wherever it stands.
    """
    found = re.search(EXTENSIONS, name)
    if found is None or not found[1]:
        return name, []
    return name.replace(found[1], ""), ["." + e for e in found[1].split(".")[1:]]


_DECIMALS, _ALONES = str.maketrans(DECIMALS), str.maketrans(ALONE)
_PYTHON = [(re.compile(p), r.replace("$1", r"\g<1>")) for p, r in (AROUND, *STEPS)]


def path_key(path: str) -> bytes:
    """Bytes whose order is the natural order of paths; those of `natural_key`."""

    def escaped(s: str) -> str:
        for c, told in ESCAPES:
            s = s.replace(c, told)
        return s

    parts, out = path.split("/"), []
    for i, part in enumerate(parts):
        stem, found = extensions(part)
        out.append(("\x00" if i == len(parts) - 1 else "\x01") + "".join(escaped(p) + "\x00" for p in (stem, *found) if p) + "\x00")
    key = "".join(out).lower().translate(_DECIMALS)
    (around, marked), *steps = _PYTHON
    key = around.sub(marked, key).translate(_ALONES)
    for pattern, by in steps:
        key = pattern.sub(by, key)
    return key.encode("utf-8", "surrogatepass")


def natural_key(path: Column | str) -> Column:
    """The sort key of a path, binary, without a Python worker."""
    path = F.col(path) if isinstance(path, str) else path
    last = F.size(F.split(path, "/")) - 1

    def escaped(c: Column) -> Column:
        told = c
        for mark, by in ESCAPES:
            told = F.replace(told, F.lit(mark), F.lit(by))
        return F.when(F.rlike(c, F.lit("[\x00-\x05]")), told).otherwise(c)

    def pieces(part: Column, i: Column) -> Column:
        found = F.regexp_extract(part, EXTENSIONS, 1)
        stem = escaped(F.when(found == "", part).otherwise(F.replace(part, found, F.lit(""))))
        ends = F.regexp_replace(escaped(found), r"(\.[^.]*)", "$1\x00")
        return F.concat(F.when(i == last, "\x00").otherwise("\x01"), F.when(stem == "", "").otherwise(F.concat(stem, F.lit("\x00"))), ends, F.lit("\x00"))

    key = F.lower(F.array_join(F.transform(F.split(path, "/"), pieces), ""))
    key = F.translate(key, "".join(DECIMALS), "".join(DECIMALS.values()))
    key = F.translate(F.regexp_replace(key, *AROUND), "".join(ALONE), "".join(ALONE.values()))
    for pattern, by in STEPS:
        key = F.regexp_replace(key, pattern, by)
    return key.cast("binary")
