"""Devices: code, screen, gray levels; and what follows from a device and a format."""

from __future__ import annotations

from dataclasses import dataclass

# Code, width, height, gray levels, name; in order of declaration.
TABLE = [
    ("K1", 600, 670, 4, "Kindle 1"),
    ("K2", 600, 670, 15, "Kindle 2"),
    ("KDX", 824, 1000, 16, "Kindle DX/DXG"),
    ("K34", 600, 800, 16, "Kindle Keyboard/Touch"),
    ("K57", 600, 800, 16, "Kindle 5/7"),
    ("KPW", 758, 1024, 16, "Kindle Paperwhite 1/2"),
    ("KV", 1072, 1448, 16, "Kindle Voyage"),
    ("KPW34", 1072, 1448, 16, "Kindle Paperwhite 3/4/Oasis"),
    ("K810", 600, 800, 16, "Kindle 8/10"),
    ("KO", 1264, 1680, 16, "Kindle Oasis 2/3"),
    ("K11", 1072, 1448, 16, "Kindle 11/2026"),
    ("KPW5", 1236, 1648, 16, "Kindle Paperwhite 5/Signature Edition"),
    ("KPW6", 1272, 1696, 16, "Kindle Paperwhite 6/2026"),
    ("KS1860", 1860, 1920, 16, "Kindle 1860"),
    ("KS1920", 1920, 1920, 16, "Kindle 1920"),
    ("KS1240", 1240, 1860, 16, "Kindle 1240"),
    ("KS1324", 1324, 1986, 16, "Kindle 1324"),
    ("KS", 1860, 2480, 16, "Kindle Scribe 1/2"),
    ("KCS", 1272, 1696, 16, "Kindle Colorsoft"),
    ("KS3", 1986, 2648, 16, "Kindle Scribe 3"),
    ("KSCS", 1986, 2648, 16, "Kindle Scribe Colorsoft"),
    ("KoMT", 600, 800, 16, "Kobo Mini/Touch"),
    ("KoG", 768, 1024, 16, "Kobo Glo"),
    ("KoGHD", 1072, 1448, 16, "Kobo Glo HD"),
    ("KoA", 758, 1024, 16, "Kobo Aura"),
    ("KoAHD", 1080, 1440, 16, "Kobo Aura HD"),
    ("KoAH2O", 1080, 1430, 16, "Kobo Aura H2O"),
    ("KoAO", 1404, 1872, 16, "Kobo Aura ONE"),
    ("KoN", 758, 1024, 16, "Kobo Nia"),
    ("KoC", 1072, 1448, 16, "Kobo Clara HD/Kobo Clara 2E/Kobo Clara BW"),
    ("KoCC", 1072, 1448, 16, "Kobo Clara Colour"),
    ("KoL", 1264, 1680, 16, "Kobo Libra H2O/Kobo Libra 2"),
    ("KoLC", 1264, 1680, 16, "Kobo Libra Colour"),
    ("KoF", 1440, 1920, 16, "Kobo Forma"),
    ("KoS", 1440, 1920, 16, "Kobo Sage"),
    ("KoE", 1404, 1872, 16, "Kobo Elipsa"),
    ("Rmk1", 1404, 1872, 16, "reMarkable 1"),
    ("Rmk2", 1404, 1872, 16, "reMarkable 2"),
    ("RmkPP", 1620, 2160, 16, "reMarkable Paper Pro"),
    ("RmkPPMove", 954, 1696, 16, "reMarkable Paper Pro Move"),
    ("OTHER", 0, 0, 16, "Other"),
    ("2400x3200", 2400, 3200, 16, "2400x3200"),
    ("1860x2480", 1860, 2480, 16, "1860x2480"),
    ("1650x2200", 1650, 2200, 16, "1650x2200"),
    ("1536x2048", 1536, 2048, 16, "1536x2048"),
    ("1404x1872", 1404, 1872, 16, "1404x1872"),
    ("1264x1680", 1264, 1680, 16, "1264x1680"),
    ("1072x1448", 1072, 1448, 16, "1072x1448"),
]

# Gray levels by their number.
PALETTES = {4: [0, 85, 170, 255], 15: [17 * i for i in range(16) if i != 14], 16: [17 * i for i in range(16)]}

FORMATS = ("cbz", "epub", "pdf")


@dataclass(frozen=True)
class Profile:
    code: str
    width: int
    height: int
    levels: int
    name: str
    order: int

    @property
    def family(self) -> str:
        if self.code == "OTHER" or self.code[0].isdigit():
            return "Other"
        return "Remarkable" if self.code.startswith("Rmk") else "Kobo" if self.code.startswith("Ko") else "Kindle"

    @property
    def palette(self) -> list[int]:
        return PALETTES[self.levels]

    @property
    def jpeg_quality(self) -> int:
        return 90 if self.code.startswith("KS") or self.code == "KCS" else 85


PROFILES = {row[0]: Profile(*row, order=i) for i, row in enumerate(TABLE)}


def closest(code: str) -> str | None:
    """The code nearest by edits, if near enough; the first declared on a tie."""

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal if x == y else 1 + min(diagonal, row[j - 1], row[j])
        return row[-1]

    found = min(PROFILES, key=lambda c: edits(code.lower(), c.lower()))
    return found if edits(code.lower(), found.lower()) <= max(1, max(len(code.encode()), 2) // 2) else None


def dataframe(spark):
    """The table, a row for each device; small, so broadcast it in joins."""
    rows = [(p.code, p.name, p.width, p.height, p.levels, p.order) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "code string, name string, width int, height int, gray_levels int, decl_ord int")


def sql_values() -> str:
    """The table as a SQL relation profiles(code, width, height, gray_levels, decl_ord)."""
    return "(VALUES " + ", ".join(f"('{c}', {w}, {h}, {n}, {i})" for i, (c, w, h, n, _) in enumerate(TABLE)) + ") AS profiles(code, width, height, gray_levels, decl_ord)"
