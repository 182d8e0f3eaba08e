"""Raster operators on images made of vectors; beyond SQL, so tests hold them to plain statements of the same rules."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import raster as R
from folioloom.operators.pages import PageOptions, page_outputs
from folioloom.profiles import PALETTES
from folioloom.sinks import books
from folioloom.sinks import images as out

from .base import query, table

ROWS = "image long, width int, height int, digest string"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 64 rows: image, y, v. A row of pixels is a vector."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id div 64 AS image", "vec_id % 64 AS y", "embedding AS e")


def raster_of(group: pd.DataFrame) -> np.ndarray:
    rows = np.stack(group.sort_values("y")["e"].to_numpy()).astype(np.float64)
    return np.clip(np.floor((rows + 0.5) * 255), 0, 255).astype(np.uint8)


def _each(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = np.ascontiguousarray(f(raster_of(group)))
        return pd.DataFrame({"image": [key[0]], "width": [a.shape[1]], "height": [a.shape[0]], "digest": [hashlib.sha1(a.tobytes()).hexdigest()]})

    return images(spark, sf_dir).groupBy("image").applyInPandas(run, ROWS)


@query()
def palette_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a: R.dither(a, PALETTES[16]))


@query()
def rainbow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, R.erase_rainbow)


@query()
def resample_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda a: R.fit(R.resample(a, (100, 90), "bicubic"), (40, 60), "lanczos"))


@query()
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content boxes and backgrounds."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = np.pad(raster_of(group), 20, constant_values=255)
        dark = R.is_dark(a)
        box = R.content_box(a, 1.0, dark, True) or (None,) * 4
        return pd.DataFrame({"image": [key[0]], "dark": [dark], **{n: [v] for n, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)}}).astype({n: "Int64" for n in ("x0", "y0", "x1", "y1")})

    return images(spark, sf_dir).groupBy("image").applyInPandas(run, "image long, dark boolean, x0 int, y0 int, x1 int, y1 int")


@query()
def webtoon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of 320 pixels cut to pages of a small screen."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = np.repeat(np.tile(raster_of(group), (1, 5)), 12, axis=0)
        a[200:280] = 255
        cut = R.split_strip(R.merge_strip([a]), 400, 300)
        return pd.DataFrame({"image": key[0], "page": range(len(cut)), "height": [len(p) for p in cut]})

    return images(spark, sf_dir).groupBy("image").applyInPandas(run, "image long, page int, height int")


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as PNG pages of books: every second one a spread."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = np.pad(raster_of(group), 30, constant_values=255)
        a = np.tile(a, (1, 2)) if key[0] % 2 else a
        return pd.DataFrame({"book_id": [f"book{key[0] // 8}"], "chapter_path": [f"book/c{key[0] % 8 // 4}"], "page_ord": [key[0]], "is_first": [key[0] % 8 == 0], "content": [out.png(a)]})

    return images(spark, sf_dir).groupBy("image").applyInPandas(run, "book_id string, chapter_path string, page_ord long, is_first boolean, content binary")


OPTIONS = PageOptions(profile="OTHER", format="cbz", splitter="both", force_png=True, custom_width=90, custom_height=120)


@query()
def page_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages decoded, judged, cropped, split, sized, dithered and encoded."""
    done = page_outputs(encoded_pages(spark, sf_dir), OPTIONS)
    return done.select("book_id", "page_ord", "piece_ord", "role", "ext", "width", "height", "black_background", F.sha1("content").alias("digest"), "error")


@query()
def book_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as archives, one a book."""
    done = page_outputs(encoded_pages(spark, sf_dir), OPTIONS)
    made = books.build_books(done, "cbz", books.BookInfo(title="Book"))
    return made.select("book_id", "format", "bytes", "pages", "chapters", F.sha1("content").alias("digest"), "error")
