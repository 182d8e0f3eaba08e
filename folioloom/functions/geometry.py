"""Sizes, boxes and decisions as column expressions: no pixels, all in whole-stage code.

Numbers are doubles until they are rounded, and every rounding is half to even unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPREAD_ASPECT, ROTATE_ASPECT, ASPECT_TOLERANCE = 1.16, 1.8, 0.015


def d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def half_even(x: Column) -> Column:
    """Whole number; what would be negative is 0."""
    return F.greatest(F.bround(x), F.lit(0.0)).cast("long")


def family(code: Column) -> Column:
    return F.when((code == "OTHER") | code.rlike("^[0-9]"), "Other").when(code.startswith("Rmk"), "Remarkable").when(code.startswith("Ko"), "Kobo").otherwise("Kindle")


def automatic_format(code: Column, nested_toc: Column) -> Column:
    of = family(code)
    return F.when(nested_toc, "epub").when(of == "Kindle", "cbz").when(of == "Remarkable", "pdf").otherwise("epub")


def target_size(code: Column, width: Column, height: Column, fmt: Column, own_width: Column, own_height: Column) -> Column:
    """struct(width, height): the device's size for a format, or what overrides say."""
    free = own_width.isNull() & own_height.isNull()
    w = F.when(free & code.startswith("KS") & (fmt == "epub"), F.least(width, F.lit(1920))).otherwise(F.coalesce(own_width, width))
    h = F.when(free & (code == "KDX") & (fmt == "cbz"), F.lit(1200)).otherwise(F.coalesce(own_height, height))
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def is_custom(own_width: Column, own_height: Column) -> Column:
    return (F.coalesce(own_width, F.lit(0)) != 0) | (F.coalesce(own_height, F.lit(0)) != 0)


def jpeg_quality(code: Column, custom: Column) -> Column:
    return F.when(~custom & (code.startswith("KS") | (code == "KCS")), 90).otherwise(85)


def gray_levels(levels: Column, custom: Column) -> Column:
    return F.when(custom, 16).otherwise(levels)


def decision(w: Column, h: Column, tw: Column, th: Column, mode: Column) -> Column:
    """normal, split, rotate or both, for a page of w x h on a screen of tw x th; mode: split, rotate or both."""
    mismatch = (w > h) != (tw > th)
    aspect = d(w) / d(h)
    return (
        F.when(mismatch & (mode == "rotate") & (w <= th) & (h <= tw), "rotate")
        .when(~(mismatch & (aspect > F.lit(SPREAD_ASPECT))), "normal")
        .when(aspect >= F.lit(ROTATE_ASPECT), "rotate")
        .otherwise(mode)
    )


def roles(decided: Column) -> Column:
    """The pieces of a page, in order."""
    names = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(decided == "normal", names("normal"))
        .when(decided == "split", names("split_first", "split_second"))
        .when(decided == "rotate", names("rotated"))
        .otherwise(names("split_first", "split_second", "rotated"))
    )


def rotate_first(pieces: Column) -> Column:
    """The pieces with a whole spread before its halves."""
    whole = F.filter(pieces, lambda p: p == "rotated")
    return F.concat(whole, F.filter(pieces, lambda p: p != "rotated"))


def fill_is_black(black_borders: Column, white_borders: Column, dark: Column) -> Column:
    return black_borders | (dark & ~white_borders)


def stacked(w: Column, h: Column) -> Column:
    """struct(width, height) of a page with its right half under its left one, or the other way round."""
    return F.struct(F.floor(w / 2).cast("int").alias("width"), (h * 2).cast("int").alias("height"))


def piece_size(w: Column, h: Column, role: Column, right_to_left: Column) -> Column:
    """struct(width, height) of a piece before it is resized; the right or lower half has the odd pixel."""
    lower = ((role == "split_second") & ~right_to_left) | ((role == "split_first") & right_to_left)
    half = lambda n: F.floor(n / 2).cast("int")
    cut = lambda n: F.when(lower, n - half(n)).otherwise(half(n))
    is_half = role.startswith("split")
    pw = F.when(role == "rotated", h).when(is_half & (w > h), cut(w)).otherwise(w)
    ph = F.when(role == "rotated", w).when(is_half & ~(w > h), cut(h)).otherwise(h)
    return F.struct(pw.cast("int").alias("width"), ph.cast("int").alias("height"))


def contain(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """struct(width, height) of the largest like-shaped size inside the target."""
    own, aim = d(w) / d(h), d(tw) / d(th)
    nw = F.when(own >= aim, tw.cast("long")).otherwise(F.greatest(half_even(d(w) / d(h) * d(th)), F.lit(1)))
    nh = F.when(own <= aim, th.cast("long")).otherwise(F.greatest(half_even(d(h) / d(w) * d(tw)), F.lit(1)))
    return F.struct(nw.cast("int").alias("width"), nh.cast("int").alias("height"))


def resize_mode(w: Column, h: Column, tw: Column, th: Column, *, upscale: Column, stretch: Column, wallpaper: Column, kdx: Column, pads: Column) -> Column:
    """stretch, fit, keep, pad or contain."""
    fits = (w <= tw) & (h <= th)
    off = F.abs(d(h) / d(w) - d(th) / d(tw))
    near = (off < F.lit(ASPECT_TOLERANCE)) | (kdx & (off < F.lit(ASPECT_TOLERANCE) * 3.0))
    return F.when(stretch, "stretch").when(wallpaper, "fit").when(fits & ~upscale, "keep").when(near, "fit").when(pads, "pad").otherwise("contain")


def resample_filter(w: Column, h: Column, tw: Column, th: Column) -> Column:
    return F.when((w <= tw) & (h <= th), "bicubic").otherwise("lanczos")


def resized(w: Column, h: Column, tw: Column, th: Column, mode: Column) -> Column:
    """struct(width, height) of the resized piece."""
    inside = contain(w, h, tw, th)
    pick = lambda keep, full, part: F.when(mode == "keep", keep).when(mode == "contain", part).otherwise(full)
    return F.struct(pick(w, tw, inside["width"]).cast("int").alias("width"), pick(h, th, inside["height"]).cast("int").alias("height"))


def pad_offset(inner: Column, outer: Column) -> Column:
    return half_even(F.greatest(d(outer) - d(inner), F.lit(0.0)) * 0.5).cast("int")


def fit_box(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """struct(left, top, right, bottom) of doubles: the centred part of the target's shape."""
    own, aim = d(w) / d(h), d(tw) / d(th)
    cw = F.when(own > aim, aim * d(h)).otherwise(d(w))
    ch = F.when(own < aim, d(w) / aim).otherwise(d(h))
    left, top = (d(w) - cw) * 0.5, (d(h) - ch) * 0.5
    return F.struct(left.alias("left"), top.alias("top"), (left + cw).alias("right"), (top + ch).alias("bottom"))


def upright(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """struct(width, height) of a spread left upright: it may take two screens side by side."""
    inside = contain(w, h, tw * 2, th)
    large = (w > tw * 2) | (h > th)
    return F.struct(F.when(large, inside["width"]).otherwise(w).cast("int").alias("width"), F.when(large, inside["height"]).otherwise(h).cast("int").alias("height"))


def crop_policy(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column, preserve: Column, minimum: Column) -> Column:
    """struct(left, top, right, bottom), or null if too little would be left: at most a tenth is cut from each side."""
    ratio = F.lit(1.0) - F.least(F.greatest(d(preserve), F.lit(0.0)), F.lit(100.0)) / 100.0
    x0, y0 = F.least(d(w) * 0.1, d(left)) * ratio, F.least(d(h) * 0.1, d(top)) * ratio
    far = lambda edge, n: edge + (d(n) - edge) * (F.lit(1.0) - ratio)
    x1, y1 = far(F.greatest(d(w) * 0.9, d(right)), w), far(F.greatest(d(h) * 0.9, d(bottom)), h)
    area = F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0)) / (d(w) * d(h))
    box = F.struct(*[half_even(v).cast("int").alias(n) for v, n in ((x0, "left"), (y0, "top"), (x1, "right"), (y1, "bottom"))])
    return F.when(area >= d(minimum), box)


# Of covers wider than so many times their height, the columns that show the front, right to left and left to right.
# They hold for columns as for numbers.
FRONT = (
    (2.0, lambda w: (w / 6.0, w / 2.0 - w * 0.02), lambda w: (w / 2.0 + w * 0.02, w * (5.0 / 6.0))),
    (1.83, lambda w: (w * 0.19, w * 0.575), lambda w: (w * 0.425, w * 0.81)),
    (1.7, lambda w: (w * 0.2, w * 0.583), lambda w: (w * 0.417, w * 0.8)),
    (1.34, lambda w: (w * 0.0, w / 2.0 - w * 0.03), lambda w: (w / 2.0 + w * 0.03, w * 1.0)),
    (1.0, lambda w: (w * 0.36, w * 1.0), lambda w: (w * 0.0, w * 0.64)),
)


def front_cover(w: Column, h: Column, right_to_left: Column) -> Column:
    """struct(left, width): the columns of a wrap-around cover that show its front."""
    wd, r = d(w), d(w) / d(h)
    left, right = F.lit(0.0), wd
    for over, rtl, ltr in reversed(FRONT):
        (a, b), (x, y) = rtl(wd), ltr(wd)
        left = F.when(r > over, F.when(right_to_left, a).otherwise(x)).otherwise(left)
        right = F.when(r > over, F.when(right_to_left, b).otherwise(y)).otherwise(right)
    a, b = half_even(left), half_even(right)
    return F.struct(a.cast("int").alias("left"), F.greatest(b - a, F.lit(1)).cast("int").alias("width"))


def thumbnail(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """struct(width, height), or null if it fits: the side that isn't bound takes the neighbour nearer in shape, the lower on a tie."""
    aspect = d(w) / d(h)

    def nearer(exact: Column, shape) -> Column:
        low, high = F.floor(exact).cast("double"), F.ceil(exact).cast("double")
        error = lambda x: F.when(x == 0.0, 0.0).otherwise(F.abs(aspect - shape(F.nullif(x, F.lit(0.0)))))
        return F.greatest(F.when(error(high) < error(low), high).otherwise(low).cast("int"), F.lit(1))

    by_height = d(tw) / d(th) >= aspect
    nw = F.when(by_height, nearer(d(th) * aspect, lambda x: x / d(th))).otherwise(tw)
    nh = F.when(by_height, th).otherwise(nearer(d(tw) / aspect, lambda x: d(tw) / x))
    return F.when(~((tw >= w) & (th >= h)), F.struct(nw.cast("int").alias("width"), nh.cast("int").alias("height")))


def virtual_page_height(strip_width: Column, tw: Column, th: Column) -> Column:
    limit = F.least(F.lit(1072), tw)
    return (d(th) / d(limit) * d(F.least(limit, strip_width))).cast("long")


def tall_slices(top: Column, bottom: Column, page: Column) -> Column:
    """array of struct(top, bottom, height): a panel as it is, as two overlapping pages, or as evenly spaced ones."""
    top, bottom, page = (c.cast("long") for c in (top, bottom, page))
    height = bottom - top
    parts = F.ceil(d(height) / d(page)).cast("long")
    spacing = F.floor(height / parts).cast("long")
    piece = lambda a, b, n: F.struct(a.alias("top"), b.alias("bottom"), n.alias("height"))
    begin, end = piece(top, top + page, page), piece(bottom - page, bottom, page)
    middle = F.transform(F.sequence(F.lit(1).cast("long"), parts - 2), lambda i: piece(top + i * spacing, top + i * spacing + page, page))
    return (
        F.when(d(height) <= d(page) * 1.5, F.array(piece(top, bottom, height)))
        .when(height <= page * 2, F.array(begin, end))
        .otherwise(F.concat(F.array(begin), middle, F.array(end)))
    )
