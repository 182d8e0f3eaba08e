"""The page operator: an encoded page becomes one to three device pages, in one Arrow pass and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folioloom.profiles import PALETTES, PROFILES
from folioloom.sinks import images as out
from folioloom.sources import images as source
from folioloom.streaming.progress import Marks

from . import raster as R


@dataclass(frozen=True)
class PageOptions:
    profile: str = "KV"
    format: str = "auto"
    right_to_left: bool = False
    cropping: str = "margins-and-page-numbers"  # disabled, margins
    cropping_power: float = 1.0
    cropping_minimum: float = 0.0
    preserve_margin: float = 0.0
    splitter: str = "split"  # rotate, both
    upscale: bool = False
    stretch: bool = False
    wallpaper: bool = False
    black_borders: bool = False
    white_borders: bool = False
    force_png: bool = False
    jpeg_quality: int | None = None
    no_rotate: bool = False
    rotate_first: bool = False
    maximize_strips: bool = False
    rotate_right: bool = False
    webtoon: bool = False
    force_color: bool = False
    force_png_rgb: bool = False
    color_autocontrast: bool = False
    png_legacy: bool = False
    no_quantize: bool = False
    no_processing: bool = False
    gamma: str = "0"
    autolevel: bool = False
    no_autocontrast: bool = False
    inter_panel: str = "disabled"  # horizontal, both
    erase_rainbow: bool = False
    custom_width: int | None = None
    custom_height: int | None = None

    @property
    def device(self):
        return PROFILES[self.profile]

    @property
    def output(self) -> str:
        """epub, cbz or pdf."""
        return self.format if self.format != "auto" else {"Kindle": "cbz", "Remarkable": "pdf"}.get(self.device.family, "epub")

    @property
    def custom(self) -> bool:
        return bool(self.custom_width) or bool(self.custom_height)

    @property
    def target(self) -> tuple[int, int]:
        w, h = self.device.width, self.device.height
        if self.custom_width is None and self.custom_height is None:
            if self.profile == "KDX" and self.output == "cbz":
                h = 1200
            if self.profile.startswith("KS") and self.output == "epub":
                w = min(w, 1920)
        return w if self.custom_width is None else self.custom_width, h if self.custom_height is None else self.custom_height

    @property
    def palette(self) -> list[int]:
        return PALETTES[16] if self.custom else self.device.palette

    @property
    def quality(self) -> int:
        return self.jpeg_quality or (85 if self.custom else self.device.jpeg_quality)

    @property
    def gray_png(self) -> bool:
        """Whether gray PNG pages keep all levels instead of a palette."""
        return self.no_quantize or self.png_legacy or self.output == "pdf" or self.output == "cbz" and self.profile in ("K1", "K2", "K34", "KDX") and not self.custom


def fill_is_black(o: PageOptions, dark: bool) -> bool:
    return o.black_borders or dark and not o.white_borders


def finish(piece: np.ndarray, role: str, color: bool, dark: bool, o: PageOptions) -> tuple[np.ndarray, str, bytes]:
    """A piece's final pixels, extension and bytes."""
    if color and o.force_color:
        a = R.gamma(R.to_rgb(piece), o.gamma)
        if not o.no_autocontrast and not o.webtoon and o.color_autocontrast:
            a = R.autocontrast(a, o.autolevel)
    else:
        a = R.to_gray(R.gamma(piece, o.gamma)) if color else R.gamma(R.to_gray(piece), o.gamma)
        if not o.no_autocontrast and not o.webtoon and not color:
            a = R.autocontrast(a, o.autolevel)
    if role == "rotated" and o.no_rotate and not o.wallpaper:
        a = R.resize_upright(a, o.target)
    else:
        plain = o.custom_width is None and o.custom_height is None
        a = R.resize_page(a, o.target, upscale=o.upscale, stretch=o.stretch, wallpaper=o.wallpaper, kdx=o.profile == "KDX" and plain, pads=o.output in ("cbz", "pdf") and not o.white_borders, fill=0 if fill_is_black(o, dark) else 255)
    if o.erase_rainbow:
        a = R.erase_rainbow(a)
    a = np.ascontiguousarray(a)
    if a.ndim == 3:
        return (a, "png", out.png(a)) if o.force_png_rgb or o.force_png else (a, "jpg", out.jpeg(a, o.quality))
    if not o.force_png:
        return a, "jpg", out.jpeg(a, o.quality)
    if o.gray_png:
        return a, "png", out.png(a)
    index = R.dither(a, o.palette)
    return np.array(o.palette, np.uint8)[index], "png", out.indexed_png(index, o.palette)


def process(pixels: np.ndarray, single: bool, first: bool, o: PageOptions) -> list[tuple[str, bool, np.ndarray, str, bytes]]:
    """(role, dark, pixels, extension, bytes) of each piece. Background and colour are judged on the whole page.

    `first`: the book's first page, which keeps its margins if it is in colour.
    """
    page = pixels
    proxy = R.to_gray(page)
    dark = R.is_dark(proxy)
    color = not single and (o.webtoon or R.has_color(R.to_rgb(page), o.force_color))
    if o.cropping != "disabled" and not o.webtoon and not (first and color):
        box = R.content_box(proxy, o.cropping_power, dark, o.cropping == "margins-and-page-numbers")
        box = box and R.crop_policy(box, *R.size(proxy), o.preserve_margin, o.cropping_minimum)
        if box:
            page, proxy = (a[box[1] : box[3], box[0] : box[2]] for a in (page, proxy))
    if o.inter_panel != "disabled":
        page = R.cut_gutters(page, proxy, dark, o.inter_panel == "both")
    w, h = R.size(page)
    if o.maximize_strips and w > h and R.decide(w, h, *o.target, o.splitter) != "normal":
        decision, page = "normal", R.stack_halves(page, o.right_to_left)
    else:
        decision = R.decide(w, h, *o.target, o.splitter)
    roles = R.ROLES[decision]
    if o.no_rotate and "rotated" in roles:
        parts = R.pieces(page, "split", o.right_to_left, False) if decision == "both" else []
        parts = [*parts, page]
    else:
        parts = R.pieces(page, decision, o.right_to_left, o.rotate_right)
    done = [(role, dark, *finish(part, role, color, dark, o)) for role, part in zip(roles, parts, strict=True)]
    return [done[-1], *done[:-1]] if decision == "both" and o.rotate_first else done


class Failed(ValueError):
    """A page that failed before it came here."""


OUTPUT = "book_id string, chapter_path string, page_ord long, piece_ord int, role string, ext string, width int, height int, black_background boolean, source_truncated boolean, content binary, error string"


def page_outputs(pages: DataFrame, options: PageOptions, marks: str | None = None) -> DataFrame:
    """Rows of OUTPUT for pages (book_id, chapter_path, page_ord, is_first, content); a page that fails is a row with its error. A column `error` tells of pages that failed before.

    `marks`: a folder to which tasks write what they have finished (columns place and places say where pages stand).

    Narrow: pages stay where they are. Arrow batches should be small, since a page is megabytes
    (spark.sql.execution.arrow.maxRecordsPerBatch of about 8).
    """
    names = [f.split()[0] for f in OUTPUT.split(", ")]
    failed = "error" in pages.columns
    places = ["place", "places"] * (marks is not None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = Marks(marks) if marks else None
        for batch in batches:
            for row in batch.itertuples(index=False):
                at = (row.book_id, row.chapter_path, row.page_ord)
                rows = []
                try:
                    if failed and row.error is not None:
                        raise Failed(row.error)
                    data = bytes(row.content)
                    if options.no_processing:
                        size = source.dimensions(data)
                        kind = source.sniff(data)
                        if size is None or kind == "bmp" and options.output == "epub":
                            raise source.ImageError("no image that can be passed through")
                        rows.append((*at, 0, "normal", kind, *size, False, False, data, None))
                    else:
                        page = source.decode(data)
                        for i, (role, dark, a, ext, body) in enumerate(process(page.pixels, page.single, bool(row.is_first), options)):
                            rows.append((*at, i, role, ext, *R.size(a), fill_is_black(options, dark), page.truncated, body, None))
                except (source.ImageError, Failed) as e:
                    error = str(e) if isinstance(e, Failed) else f"page_processing_failed: {e}"
                    rows.append((*at, None, None, None, None, None, None, None, None, error))
                if told:
                    told.add(row.book_id, int(row.place), int(row.places), row.chapter_path, len(rows), rows[0][-1])
                yield pd.DataFrame(rows, columns=names).astype({"piece_ord": "Int64", "width": "Int64", "height": "Int64"})
        if told:
            told.flush()

    return pages.select("book_id", "chapter_path", "page_ord", "is_first", "content", *["error"] * failed, *places).mapInPandas(run, OUTPUT)


def webtoon_pages(pages: DataFrame, tw: int, th: int) -> DataFrame:
    """Chapters of strips as pages: book_id, chapter_path, page_ord, is_first, content, error. One task holds one chapter, which is bounded by a strip's limits.

    A chapter that can't be read or cut is one row with its error, and the others go on.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cut, error = [], None
        try:
            strips = [source.decode(bytes(c)).pixels for c in group.sort_values("page_ord")["content"]]
            cut = [out.png(R.to_rgb(p)) for p in R.split_strip(R.merge_strip(strips), tw, th)]
        except ValueError as e:
            error = f"webtoon_split_failed: {key[1] or 'the book'}: {e}"
        return pd.DataFrame({"book_id": key[0], "chapter_path": key[1], "page_ord": range(len(cut) + (error is not None)), "is_first": False, "content": [*cut, *[None] * (error is not None)], "error": error})

    return pages.groupBy("book_id", "chapter_path").applyInPandas(run, "book_id string, chapter_path string, page_ord long, is_first boolean, content binary, error string")
