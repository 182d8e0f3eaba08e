"""Names, titles and markup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of generated book identifiers, this library's own.
NAMESPACE = "9c1f6a52-3f0e-5d0b-8a57-6b1f0c2d4e71"
# Fixed values.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp")
UNSAFE = "/\\?%*:;|\"'><$!"
DEVICE_NAMES = ("con", "prn", "aux", "nul", *[f"com{i}" for i in "123456789¹²³"], *[f"lpt{i}" for i in "123456789¹²³"])


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last component, empty if it has none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]*)$", 1))


def is_page_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS) & ~F.array_contains(F.split(path, "/"), "__MACOSX") & ~F.element_at(F.split(path, "/"), -1).startswith("._")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def zero_fill(text: Column, width: int) -> Column:
    """Zeros up to a width in characters, after a leading sign."""
    missing = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(text), F.lit(0)).cast("int"))
    return F.when(text.rlike(r"^[+-]"), F.concat(F.substring(text, 1, 1), missing, F.substring(text, 2, 1_000_000))).otherwise(F.concat(missing, text))


def xml_escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def title(series: Column, volume: Column, number: Column, own: Column, fallback: Column, mode: Column) -> Column:
    """A title from metadata; mode: series_only, combine or title_only. Null parts are left out."""
    composed = F.concat(
        F.coalesce(series, fallback),
        F.coalesce(F.concat(F.lit(" Vol. "), zero_fill(volume, 2)), F.lit("")),
        F.coalesce(F.concat(F.lit(" #"), zero_fill(number, 3)), F.lit("")),
        F.when(mode == "combine", F.coalesce(F.concat(F.lit(": "), own), F.lit(""))).otherwise(F.lit("")),
    )
    return F.when(mode == "title_only", F.coalesce(own, fallback)).otherwise(composed)


def series_position(volume: Column, number: Column) -> Column:
    v, n = (F.nullif(x, F.lit("")) for x in (volume, number))
    return F.coalesce(F.concat(v, F.lit("."), n), v, n)


def safe_stem(text: Column) -> Column:
    """For readers that stumble over some marks: each becomes an underscore."""
    return F.translate(text, UNSAFE, "_" * len(UNSAFE))


def pdf_text(text: Column) -> Column:
    return F.concat(F.lit("FEFF"), F.hex(F.encode(text, "UTF-16BE")))


def utc_stamp(seconds: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def uuid5(seed: Column) -> Column:
    """A version-5 identifier of a seed in this library's namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(seed, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def portable_stem(text: Column) -> Column:
    """A file stem that any system takes: no control characters, illegal marks as hyphens, no dot or space at its end."""
    s = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    s = F.regexp_replace(s, r'[<>:"/\\|?*]', "-")
    s = F.regexp_replace(s, r"[. ]+$", "")
    s = F.when(s == "", "book").otherwise(s)
    return F.when(is_device(s), F.concat(F.lit("_"), s)).otherwise(s)


def cut_bytes(text: Column, most: Column | int) -> Column:
    """The longest beginning of at most so many UTF-8 bytes, whole characters only."""
    chars = F.split(text, "")
    ends = F.transform(chars, lambda c, i: F.octet_length(F.substring(text, F.lit(1), i + 1)))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.size(F.filter(ends, lambda n: n <= most))))


def generated_name(stem: Column, suffix: str, extension: str, most: int = 255) -> Column:
    """stem, suffix and extension as a name of at most `most` bytes, of which the stem gives way, to four bytes."""
    tail = suffix + extension
    room = max(4, most - len(tail.encode()))
    return F.concat(F.regexp_replace(cut_bytes(stem, room), r"[. ]+$", ""), F.lit(tail))


def alternate_name(stem: Column, extension: str, turn: Column) -> Column:
    """The name of the book whose turn it is (from 0) among those of one stem."""
    suffix = F.when(turn == 0, "").when(turn == 1, " (folioloom)").otherwise(F.concat(F.lit(" (folioloom "), turn.cast("string"), F.lit(")")))
    return F.concat(stem, suffix, F.lit(extension))


def is_device(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(name, r"^([^.]*)", 1), " +$", "")).isin(*DEVICE_NAMES)


def is_valid_name(name: Column) -> Column:
    """Whether a file may have this name on any system: 255 bytes, no control or illegal marks, no device, no dot or space at its end."""
    return (F.octet_length(name) <= 255) & ~name.rlike(r'[\x00-\x1f\x7f<>:"/\\|?*]') & ~name.rlike(r"[. ]$") & ~is_device(name) & (name != "")


def clean(field: Column) -> Column:
    """Without white space of any script around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(field, r"(?U)^\s+|\s+$", ""), F.lit(""))


def people(*roles: Column) -> Column:
    """All names of all roles, each once, by code points."""
    names = F.flatten(F.array(*[F.split(F.coalesce(r, F.lit("")), ", ") for r in roles]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")))


def chapter_folder(directory: Column, title: Column) -> Column:
    """A chapter's folder in an archive: plain components only, else its title."""
    parts = F.filter(F.split(directory, "/"), lambda p: ~p.isin("", ".", ".."))
    folder = F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\"), F.lit("-"))), "/")
    return F.when(folder == "", F.regexp_replace(title, r"[/\\]", "-")).otherwise(folder)


def media_type(ext: Column) -> Column:
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp")
