"""Books from archives or folders: scan, metadata, pages, webtoon strips, labelled spreads, covers, assembly, publication.

Pages of all books are dealt over all tasks and worked on together; they are shuffled by chapter (webtoons) and by book
(assembly), where a book's metadata and cover join them. Nothing but counts comes to the driver, and books are written
by tasks. Errors are rows: a page or book that fails is reported in `issues` and the others go on.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom import profiles
from folioloom.functions import geometry, natural, text
from folioloom.operators import books as B
from folioloom.operators import pages as P
from folioloom.operators import raster as R
from folioloom.sinks import books, shelf
from folioloom.sinks import images as out
from folioloom.sources import archives, entries
from folioloom.sources import images as source

# What a widespread converter puts into names of pages and of books that it writes.
CONVERTED, CONVERTED_BOOK = "-kcc", "_kcc"

# Codes that an issue may have, by stage.
ISSUES = {
    "configuration": ["invalid_arguments", "unknown_profile", "nested_toc_unsupported_format", "invalid_resolution"],
    "inspect": ["input_not_found", "input_read_failed", "input_empty", "skipped_non_images", "link_skipped", "no_page_images", "source_already_converted", "images_smaller_than_device", "cover_read_failed", "spread_labels_read_failed", "spread_labels_ignored", "spread_labels_skipped", "spread_join_failed"],
    "metadata": ["comic_info_unreadable", "metadata_parse_failed"],
    "plan": ["output_collision", "output_exists", "output_plan_failed"],
    "write": ["output_directory_create_failed", "output_write_failed"],
    "process": ["page_truncated", "page_processing_failed", "webtoon_split_failed"],
    "package": ["cover_build_failed", "book_build_failed"],
    "protocol": ["event_write_failed"],
}


class ConversionError(ValueError):
    def __init__(self, code: str, message: str):
        self.code, self.stage = code, next(s for s, codes in ISSUES.items() if code in codes)
        super().__init__(message)


@dataclass(frozen=True)
class Request:
    """What to make; None stands for what follows from the input."""

    options: P.PageOptions = P.PageOptions()
    title: str | None = None
    author: str | None = None
    title_mode: str = "series_only"  # combine, title_only
    language: str = "en-US"
    nested_toc: bool = False
    keep_comic_info: bool = False
    spread_shift: bool = False
    one_page: bool = False
    invert_direction: bool = False
    kepub: bool = True
    smart_cover_crop: bool = False
    cover_fill: bool = False
    labels: tuple[int, ...] = ()  # for every book; None of them: those of a file beside a book, named like it plus .json
    cover: str | None = None  # an image for every book; None: those of a folder Covers beside the books


def resolve(request: Request) -> Request:
    """Checks the request in order: profile, format, resolution, contents."""
    o = request.options
    if o.profile not in profiles.PROFILES:
        near = profiles.closest(o.profile)
        raise ConversionError("unknown_profile", f"unknown profile {o.profile}" + (f"; did you mean {near}?" if near else ""))
    if o.webtoon:
        o = replace(o, right_to_left=False, upscale=False, white_borders=True, black_borders=False)
    if o.format == "auto":
        o = replace(o, format="epub" if request.nested_toc else o.output)
    if request.nested_toc and o.format == "cbz":
        raise ConversionError("nested_toc_unsupported_format", "an archive has no table of contents")
    if min(o.target) <= 0:
        raise ConversionError("invalid_resolution", f"no page fits {o.target[0]} x {o.target[1]}")
    return replace(request, options=o)


def list_profiles(spark: SparkSession) -> DataFrame:
    return profiles.dataframe(spark).orderBy("decl_ord")


def scan(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Entries (`archives.ENTRIES`) of an archive of any name, a folder of pages, or a folder of archives and any pages beside them.

    Paths that Python workers can read are read by ranges. On file systems that only Spark knows, archives are read whole
    (2 GiB at most) and by their endings. content: False leaves pages out and keeps their sizes.
    """
    if archives.readable(path):
        return archives.books(spark, path, content)
    zipped = entries.zip_entries(spark, path)
    loose = entries.folder_entries(spark, path)
    # numbered by name alone, so that no contents pass one task
    number = (F.row_number().over(Window.partitionBy("book_id").orderBy("key")) - 1).cast("long")
    placed = loose.select("book_id", "rel_path", number.alias("ord"))
    loose = loose.drop("key").join(placed, ["book_id", "rel_path"]).where(~F.startswith("rel_path", F.lit(f"{archives.COVERS}/")))
    rows = zipped.unionByName(loose.select(zipped.columns))

    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None if c is None else source.dimensions(bytes(c))) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")

    firsts = rows.where(F.col("content").isNotNull() & (F.col("rel_path") != entries.INFO)).groupBy("book_id").agg(F.min("ord").alias("_first"))
    rows = rows.join(firsts, "book_id", "left").withColumn("_size", size("content"))
    return rows.select("book_id", "rel_path", "ord", "length", F.coalesce(F.col("ord") == F.col("_first"), F.lit(False)).alias("is_first"), "_size.*", F.when(F.lit(content) | (F.col("rel_path") == entries.INFO), F.col("content")).alias("content"), "issue")


def page_rows(scanned: DataFrame) -> DataFrame:
    """Pages of scanned entries: book_id, chapter_path, page_ord, is_first, source_path, width, height, content."""
    kept = scanned.where(F.col("rel_path").isNotNull() & F.col("issue").isNull() & (F.col("rel_path") != entries.INFO))
    directory = F.when(F.contains("rel_path", F.lit("/")), F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)).otherwise("")
    return kept.select("book_id", directory.alias("chapter_path"), F.col("ord").alias("page_ord"), "is_first", F.col("rel_path").alias("source_path"), "width", "height", "content")


def metadata(scanned: DataFrame) -> DataFrame:
    """book_id, info (JSON of the fields), issue and raw of each book with a metadata file."""

    def run(batches):
        for b in batches:
            found = []
            for data in b["content"]:
                try:
                    found.append((json.dumps(entries.comic_info(entries.text_of(bytes(data)))), None))
                except ValueError as e:
                    found.append((None, f"comic_info_unreadable: {e}"))
            yield pd.DataFrame({"book_id": b["book_id"], "info": [f for f, _ in found], "issue": [i for _, i in found], "raw": b["content"]})

    return scanned.where((F.col("rel_path") == entries.INFO) & F.col("content").isNotNull()).select("book_id", "content").mapInPandas(run, "book_id string, info string, issue string, raw binary")


def zero_fill(s: str, width: int) -> str:
    sign = s[:1] if s[:1] in ("+", "-") else ""
    return sign + "0" * max(0, width - len(s)) + s[len(sign) :]


def book_info(info: dict | None, request: Request, fallback: str) -> books.BookInfo:
    """Title, authors, series and the like, by what takes precedence."""
    info = info or {}
    get = lambda k: info.get(k) or None
    title, position = request.title or fallback, None
    if request.title_mode == "title_only":
        title = get("title") or title
    elif request.title is None and info:
        title = get("series") or fallback
        title += f" Vol. {zero_fill(get('volume'), 2)}" if get("volume") else ""
        title += f" #{zero_fill(get('number'), 3)}" if get("number") else ""
        title += f": {get('title')}" if request.title_mode == "combine" and get("title") else ""
        position = ".".join(filter(None, (get("volume"), get("number")))) or None
    people = sorted({p for k in ("writers", "pencillers", "inkers", "colorists") for p in info.get(k, ())})
    authors = [request.author] if request.author else people or ["Unknown"]
    o = request.options
    return books.BookInfo(title=title, authors=authors, language=request.language, summary=get("summary"), series=get("series"), position=position, right_to_left=o.right_to_left, spread_shift=request.spread_shift, one_page=request.one_page, invert=request.invert_direction, kindle=o.device.family == "Kindle", nested=request.nested_toc, bookmarks=[tuple(m) for m in info.get("bookmarks", ())], size=None if o.custom else o.target)


def front(w: int, h: int, right_to_left: bool) -> tuple[int, int]:
    """The first column and the number of columns of a wrap-around cover's front."""
    for over, rtl, ltr in geometry.FRONT:
        if w / h > over:
            left, right = (rtl if right_to_left else ltr)(float(w))
            return R.half_even(left), max(1, R.half_even(right) - R.half_even(left))
    return 0, w


def cover(data: bytes, request: Request) -> tuple[bytes, bool]:
    """A cover's JPEG, and whether its front was cut out of a wider image."""
    o = request.options
    a = R.autocontrast_tone(R.to_rgb(source.decode(data).pixels))
    a = a if o.force_color else R.to_gray(a)
    w, h = R.size(a)
    cut = request.smart_cover_crop and w > h
    if cut:
        x0, width = front(w, h, o.right_to_left)
        a = a[:, x0 : x0 + width]
    if request.cover_fill:
        a = R.fit(a, o.target, "lanczos")
    elif size := thumbnail(*R.size(a), *o.target):
        a = R.resample(a, size, "lanczos")
    return out.jpeg(a, o.quality), cut


def thumbnail(w: int, h: int, tw: int, th: int) -> tuple[int, int] | None:
    if tw >= w and th >= h:
        return None
    aspect = w / h

    def nearer(exact: float, shape) -> int:
        low, high = int(exact), -int(-exact // 1)
        error = lambda x: abs(aspect - shape(x)) if x else 0.0
        return max(1, high if error(high) < error(low) else low)

    return (nearer(th * aspect, lambda x: x / th), th) if tw / th >= aspect else (tw, nearer(tw / aspect, lambda x: tw / x))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def labels_beside(spark: SparkSession, path: str) -> DataFrame:
    """book_id, positions and issue of the label files ({"spreads": [12, 40]}) beside the books at a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    empty = spark.createDataFrame([], "book_id string, positions array<int>, issue string")
    if not exists(spark, path) or not path.endswith("/") and not os.path.isdir(path) and not exists(spark, f"{path}.json"):
        return empty

    def run(batches):
        for b in batches:
            rows = []
            for at, content in zip(b["path"], b["content"], strict=True):
                positions, issue = None, None
                try:
                    positions = json.loads(bytes(content).decode())["spreads"]
                    if not isinstance(positions, list) or any(type(p) is not int or p < 0 for p in positions):
                        raise ValueError("a position is no whole number from 0 up")
                except (ValueError, KeyError, TypeError) as e:
                    positions, issue = None, f"spread_labels_read_failed: {e}"
                rows.append((at.removesuffix(".json"), positions, issue))
            yield pd.DataFrame(rows, columns=["book_id", "positions", "issue"])

    return files.load(path if exists(spark, path) and not exists(spark, f"{path}.json") else f"{path}.json").select("path", "content").mapInPandas(run, empty.schema)


def own_covers(spark: SparkSession, path: str, book_ids: DataFrame, request: Request) -> DataFrame | None:
    """book_id and own (the image) of books with a cover of their own. Names of one folder are ranked by themselves; images meet their books afterwards."""
    if request.cover:
        image = spark.read.format("binaryFile").load(request.cover)
        size = [r["length"] for r in image.select("length").limit(2).collect()]
        if len(size) != 1 or size[0] > source.MAX_BYTES:
            raise ConversionError("cover_read_failed", f"a cover is one image of {source.MAX_BYTES} bytes at most")
        return book_ids.crossJoin(F.broadcast(image.select(F.col("content").alias("own"))))  # one image of a checked size
    folder = f"{path if os.path.isdir(path) or not path.lower().endswith(('.cbz', '.zip')) else os.path.dirname(path)}/Covers"
    if not exists(spark, folder):
        return None
    placed = lambda df, name: df.select(name, text.stem(F.col(name)).alias("name"), F.row_number().over(Window.orderBy(natural.natural_key(name))).cast("long").alias("ord"))
    images = spark.read.format("binaryFile").load(folder).where(text.is_page_image(F.col("path")))
    contents = images.select("path", F.col("content").alias("own"))
    images = placed(images.select("path"), "path")
    listed = placed(book_ids.where(~F.contains("book_id", F.lit(f" ({books.NAME}")) & ~F.contains(F.element_at(F.split("book_id", "/"), -1), F.lit(CONVERTED_BOOK))), "book_id")
    met = B.covers(listed.select("name", "ord"), images.select("name", "ord"))
    return listed.select("book_id", "name").join(met, F.col("name") == F.col("book")).join(images.groupBy(F.col("name").alias("cover")).agg(F.min("path").alias("path")), "cover").join(contents, "path").select("book_id", "own")


def paired(labels: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Labels that begin a pair, and those that are the second page of the pair before."""
    firsts, seconds = [], []
    for p in sorted(set(labels)):
        (seconds if firsts and firsts[-1] == p - 1 else firsts).append(p)
    return firsts, seconds


def position_after(position: int, firsts: list[int], total: int) -> int:
    """Where a page position lies once the pairs that a book of `total` pages has are joined."""
    return position - sum(p < position for p in firsts if p + 1 < total)


def pairs_of(labels: DataFrame) -> DataFrame:
    """book_id, firsts and seconds of each book's labels (book_id, positions)."""

    def run(batches):
        for b in batches:
            found = [paired(tuple(p)) for p in b["positions"]]
            yield pd.DataFrame({"book_id": b["book_id"], "firsts": [f for f, _ in found], "seconds": [x for _, x in found]})

    return labels.where("positions IS NOT NULL").mapInPandas(run, "book_id string, firsts array<int>, seconds array<int>")


def join_spreads(pages: DataFrame, labels: tuple[int, ...] | DataFrame, right_to_left: bool) -> tuple[DataFrame, DataFrame]:
    """Joins each labelled page (position in its book) with the next one; labels that could not be used: book_id, position, reason.

    labels: those of every book, or what `pairs_of` gives for some. A page meets its partner through a shuffle by book and pair.
    """
    book = Window.partitionBy("book_id")
    names = pages.select("book_id", "page_ord")  # positions are found without contents
    placed = names.withColumn("_p", F.row_number().over(book.orderBy("page_ord")) - 1).withColumn("_n", F.count(F.lit(1)).over(book))
    of_book = names.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(labels, tuple):
        told = [F.array(*map(F.lit, x)).cast("array<int>") for x in paired(labels)]
        placed, of_book = (df.withColumn("_firsts", told[0]).withColumn("_seconds", told[1]) for df in (placed, of_book))
    else:
        named = labels.select("book_id", F.col("firsts").alias("_firsts"), F.col("seconds").alias("_seconds"))
        placed, of_book = placed.join(named, "book_id"), of_book.join(named, "book_id")
    reason = F.when(F.col("position") + 1 >= F.col("n"), "no_page_after").when(F.array_contains("_seconds", F.col("position")), "part_of_previous_pair")
    skipped = of_book.withColumn("position", F.explode(F.array_union("_firsts", "_seconds"))).select("book_id", "position", reason.alias("reason")).where("reason IS NOT NULL")
    usable = lambda p: F.coalesce(F.array_contains("_firsts", p), F.lit(False)) & (p + 1 < F.col("_n"))
    pair = F.when(usable(F.col("_p") - 1), F.col("_p") - 1).when(usable(F.col("_p")), F.col("_p"))
    twins = placed.withColumn("_pair", pair).where("_pair IS NOT NULL").select("book_id", "page_ord", "_pair")  # two rows for a label that is used

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("page_ord").drop(columns="_pair")
        first = group.iloc[:1].copy()
        try:
            a, b = (source.decode(bytes(c)).pixels for c in group["content"])
            whole = R.join_pair(a, b, right_to_left)
        except source.ImageError:  # the pages stay apart, and the page operator tells what is wrong with them
            return group
        first["content"], first["width"], first["height"] = [out.png(whole)], *([n] for n in R.size(whole))
        first["is_first"] = bool(group["is_first"].any())
        return first

    single = pages.join(twins, ["book_id", "page_ord"], "left_anti")
    twos = pages.join(twins, ["book_id", "page_ord"]).select(*pages.columns, "_pair").groupBy("book_id", "_pair").applyInPandas(run, pages.schema)
    return single.unionByName(twos), skipped


@dataclass
class Result:
    """books and issues are made of the same finished pages, which are kept in memory or on disk until `release`; lost ones are made again."""

    books: DataFrame
    issues: DataFrame
    parts: DataFrame
    scanned: DataFrame
    request: Request  # resolved
    modified: str

    def release(self) -> None:
        self.parts.unpersist()
        self.scanned.unpersist()


#: Rows of a book that are no pages: metadata comes first, then the cover.
INFO_ROW, COVER_ROW = -2, -1


def cover_rows(fronts: DataFrame, request: Request) -> DataFrame:
    """A row as of a page for the cover made of each book's image (book_id, content, and whether it is a book's own), or for why there is none."""
    names = [f.split()[0] for f in P.OUTPUT.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for book, content, own in zip(b["book_id"], b["content"], b["is_own"], strict=True):
                try:
                    made, cut = cover(bytes(content), request)
                    if request.options.output == "epub" or cut or own:
                        rows.append((book, "", COVER_ROW, 0, "cover", "jpg", None, None, False, False, made, None))
                except source.ImageError as e:
                    rows.append((book, "", COVER_ROW, 0, "cover", None, None, None, False, False, None, f"{'cover_read_failed' if own else 'cover_build_failed'}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype({"piece_ord": "Int64", "width": "Int64", "height": "Int64"})

    return fronts.select("book_id", "content", "is_own").mapInPandas(run, P.OUTPUT)


def inside(chapter: str) -> str:
    """A path in a chapter."""
    return f"{chapter}/p" if chapter else "p"


def reading_order(webtoon: bool) -> list[Column]:
    """Order of a book's pages. Those of a webtoon are numbered in each chapter, and its chapters are in natural order."""
    path = F.when(F.col("chapter_path") == "", "p").otherwise(F.concat("chapter_path", F.lit("/p")))
    return [*([natural.natural_key(path)] if webtoon else []), F.col("page_ord"), F.col("chapter_path")]


def described(book_id: str, told, cover: bytes | None, request: Request, modified: str) -> books.BookInfo:
    """What a book's info row and its cover say of it; `told` is that row, or null."""
    about = {} if told is None else json.loads(told["chapter_path"])
    info = book_info(json.loads(about["info"]) if about.get("info") else None, request, stem(book_id))
    total = 0 if told is None else int(told["height"])
    info.bookmarks = [(position_after(p, about.get("firsts") or [], total), name) for p, name in info.bookmarks]
    if told is not None and request.keep_comic_info and request.options.output == "cbz" and told["content"] is not None:
        info.comic_info = bytes(told["content"])
    info.modified, info.cover = modified, cover
    return info


def spread_pages(pages: DataFrame) -> DataFrame:
    """Pages dealt over all tasks, so one volume keeps all cores busy; a few tasks a core even out what a hash deals unevenly."""
    conf = pages.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), 4 * pages.sparkSession.sparkContext.defaultParallelism)
    return pages.repartition(n, "book_id", "page_ord")


def convert(spark: SparkSession, path: str, request: Request, marks: str | None = None) -> Result:
    """Finished books as rows, with what went wrong. `marks`: a folder for what `streaming.progress` follows."""
    request = resolve(request)
    o = request.options
    # each member is inflated once; what books, covers and issues need is read from here, and made again if an executor is lost
    scanned = scan(spark, path).persist(StorageLevel.DISK_ONLY)
    found = page_rows(scanned)
    totals = found.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    skipped = None
    if request.labels:
        totals = totals.withColumn("firsts", F.array(*map(F.lit, paired(request.labels)[0])).cast("array<int>"))
        found, skipped = join_spreads(found, request.labels, o.right_to_left)
    else:
        beside = labels_beside(spark, path)
        pairs = pairs_of(beside)
        totals = totals.join(pairs.select("book_id", "firsts"), "book_id", "left")
        if not beside.isEmpty():
            found, skipped = join_spreads(found, pairs, o.right_to_left)
    pages = P.webtoon_pages(found, *o.target) if o.webtoon else found.select("book_id", "chapter_path", "page_ord", "is_first", "content")
    if not o.webtoon and not archives.readable(path):  # what is read by ranges is dealt over all tasks as it is read
        pages = spread_pages(pages)
    if marks is not None:  # places follow from names and numbers alone
        names, book = pages.select("book_id", "chapter_path", "page_ord"), Window.partitionBy("book_id")
        first = F.row_number().over(book.orderBy(*reading_order(o.webtoon))) - 1
        pages = pages.join(names.select("book_id", "chapter_path", "page_ord", first.cast("long").alias("place"), F.count(F.lit(1)).over(book).alias("places")), ["book_id", "chapter_path", "page_ord"])
    done = P.page_outputs(pages, o, marks)
    as_page = lambda df, info, content, error: df.select("book_id", F.coalesce(info, F.lit("")).alias("chapter_path"), F.lit(INFO_ROW).cast("long").alias("page_ord"), F.lit(0).alias("piece_ord"), F.lit("info").alias("role"), F.lit("xml").alias("ext"), F.lit(None).cast("int").alias("width"), F.col("n").cast("int").alias("height"), F.lit(False).alias("black_background"), F.lit(False).alias("source_truncated"), content.alias("content"), error.alias("error"))
    about = as_page(totals.join(metadata(scanned), "book_id", "left"), F.to_json(F.struct("info", "firsts")), F.col("raw"), F.col("issue"))
    parts = done.unionByName(about)
    if o.output != "pdf" and not o.webtoon:
        fronts = found.where("is_first").select("book_id", "content")  # a joined pair stands for its first page
        own = own_covers(spark, path, totals.select("book_id"), request)
        fronts = fronts.withColumn("is_own", F.lit(False)) if own is None else fronts.join(own, "book_id", "left").select("book_id", F.coalesce("own", "content").alias("content"), F.col("own").isNotNull().alias("is_own"))
        parts = parts.unionByName(cover_rows(fronts, request))

    parts = parts.persist()
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        told = group[group["role"] == "info"]
        front = group[(group["role"] == "cover") & group["error"].isna()]
        info = described(key[0], None if told.empty else told.iloc[0], bytes(front["content"].iloc[0]) if len(front) else None, request, now)
        rows = group[group["error"].isna() & (group["page_ord"] >= 0)]
        chapter = [natural.path_key(inside(c)) if o.webtoon else b"" for c in rows["chapter_path"]]
        rows = rows.assign(chapter=chapter).sort_values(["chapter", "page_ord", "piece_ord", "chapter_path"])
        made = [books.Page(r.chapter_path, r.ext, bytes(r.content), r.role, bool(r.black_background), r.piece_ord > 0) for r in rows.itertuples()]
        try:
            data, error = books.BUILDERS[o.output](made, info), None
        except ValueError as e:
            data, error = None, f"book_build_failed: {e}"
        return pd.DataFrame({"book_id": [key[0]], "format": o.output, "bytes": len(data or b""), "pages": len(made), "chapters": len(books.chapters(made)), "content": [data], "error": [error]})

    made = parts.groupBy("book_id").applyInPandas(run, books.BOOKS)
    issue = lambda df, told, path: df.where(told.isNotNull()).select("book_id", F.element_at(F.split(told, ":"), 1).alias("code"), told.alias("diagnostic"), path.alias("path"))
    none = F.lit(None).cast("string")
    issues = issue(scanned, F.col("issue"), F.col("rel_path"))
    issues = issues.unionByName(issue(parts, F.col("error"), F.when(F.col("page_ord") >= 0, F.col("page_ord").cast("string"))))
    issues = issues.unionByName(parts.where("source_truncated").select("book_id", F.lit("page_truncated").alias("code"), none.alias("diagnostic"), F.col("page_ord").cast("string").alias("path")))
    issues = issues.unionByName(warnings(spark, scanned, request))
    if not request.labels:
        issues = issues.unionByName(issue(beside, F.col("issue"), none))
    if skipped is not None:
        issues = issues.unionByName(skipped.select("book_id", F.lit("spread_labels_skipped").alias("code"), F.concat(F.lit("position "), "position", F.lit(": "), "reason").alias("diagnostic"), none.alias("path")))
    return Result(made, issues, parts, scanned, request, now)


def measured(pages: DataFrame, request: Request) -> DataFrame:
    """Of each book: pages, those smaller than the screen, and those whose size is known from the header."""
    tw, th = request.options.target
    small = F.count_if((F.col("width") < tw) & (F.col("height") < th))
    return pages.groupBy("book_id").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("chapter_path").alias("chapters"), small.alias("smaller"), F.count("width").alias("measured"))


def warns_of_small(request: Request) -> bool:
    o = request.options
    return not (o.upscale or o.stretch or o.webtoon or o.profile.startswith("KS"))


def warnings(spark: SparkSession, scanned: DataFrame, request: Request) -> DataFrame:
    """Issues of whole books: no pages, converted already (by this library, or by one that marks its pages so), many pages smaller than the screen."""
    found = page_rows(scanned).drop("content")
    every = scanned.where(F.col("issue").isNull() | ~F.startswith("issue", F.lit("skipped_non_images:"))).select("book_id").distinct()
    columns = lambda df, code, told: df.select("book_id", F.lit(code).alias("code"), told.cast("string").alias("diagnostic"), F.lit(None).cast("string").alias("path"))
    out_ = columns(every.join(found.select("book_id").distinct(), "book_id", "left_anti"), "no_page_images", F.lit(None))
    own = F.contains(F.lower(F.element_at(F.split("book_id", "/"), -1)), F.lit(f"({books.NAME}"))
    marked = found.where(F.contains(text.stem(F.element_at(F.split("source_path", "/"), -1)), F.lit(CONVERTED))).select("book_id")
    out_ = out_.unionByName(columns(every.where(own).union(marked).distinct(), "source_already_converted", F.lit(None)))
    if warns_of_small(request):
        small = measured(found, request).where("smaller * 4 > measured")
        out_ = out_.unionByName(columns(small, "images_smaller_than_device", F.concat_ws(" of ", "smaller", "measured")))
    return out_


def stem(book_id: str) -> str:
    return os.path.splitext(os.path.basename(book_id.rstrip("/")))[0] or "book"


def extension(request: Request) -> str:
    o = request.options
    kobo = o.output == "epub" and o.device.family == "Kobo" and not o.custom and request.kepub
    return ".kepub.epub" if kobo else f".{o.output}"


def output_name(request: Request) -> Column:
    """The name planned for a book of book_id: a portable stem, within 255 bytes with its extension and any suffix."""
    base = text.portable_stem(F.regexp_replace(F.element_at(F.split("book_id", "/"), -1), r"(?<=.)\.[^.]*$", ""))
    base = text.safe_stem(base) if extension(request) == ".kepub.epub" else base
    room = 255 - len(f" ({books.NAME} 9999)") - len(extension(request))
    return F.concat(F.regexp_replace(text.cut_bytes(base, room), r"[. ]+$", ""), F.lit(extension(request)))


def destination(path: str, output: str | None) -> tuple[str, str | None]:
    """The folder for the books and, where one file was asked for, its name; by default the folder of the input. Raises before anything is written."""
    if output is None:
        output = path if os.path.isdir(path) else os.path.dirname(archives.named(path).removeprefix("file:"))
    try:
        return shelf.check(output)
    except shelf.PlanError as e:
        raise ConversionError(e.code, str(e)) from e


def planned(book_ids: DataFrame, folder: str, request: Request, name: str | None = None) -> DataFrame:
    """book_id, name, turn, output and code: where each book goes, and whether its name is taken (output_exists), by the input itself (output_collision)."""
    names = book_ids.select("book_id", output_name(request).alias("name") if name is None else F.lit(name).alias("name"))
    rows = shelf.planned(names, shelf.taken(book_ids.sparkSession, folder))
    own = F.concat(F.lit(archives.named(folder) + "/"), "name") == F.col("book_id")
    return rows.select("book_id", "name", "turn", F.concat(F.lit(folder.rstrip("/") + "/"), "output").alias("output"), F.when(own, "output_collision").when(F.col("occupied"), "output_exists").alias("code"))


def dry_run(spark: SparkSession, path: str, request: Request, output: str | None = None) -> DataFrame:
    """Of each book: pages, chapters, pages smaller than the screen and the name planned (with `output`: the path, and a code if its own name is taken). Reads headers, decodes and writes nothing."""
    request = resolve(request)
    place = None if output is None else destination(path, output)
    rows = measured(page_rows(scan(spark, path, content=False)), request).withColumn("warn_small", (F.col("smaller") * 4 > F.col("measured")) & F.lit(warns_of_small(request)))
    if place is None:
        return rows.withColumn("output", output_name(request))
    return rows.join(planned(rows.select("book_id"), place[0], request, place[1]).select("book_id", "output", "code"), "book_id")


def written(result: Result, folder: str, request: Request, name: str | None = None, stage: str | None = None, keep: bool = False) -> DataFrame:
    """Publishes the books from their tasks, through a stage in the folder; book_id, path, bytes, pages, error of each.

    A book is written page by page (`shelf.staged`), so it may be larger than memory.
    Nothing is overwritten. Books of one name are told apart by their order, so a job that runs again finds its files.
    name: that of the only book; stage: one opened before page work, which the caller closes if it is to be kept.
    """
    same = Window.partitionBy(F.lower("name")).orderBy("book_id")
    every = result.parts.select("book_id").distinct()
    names = every.withColumn("name", output_name(request) if name is None else F.lit(name)).withColumn("turn", (F.row_number().over(same) - 1).cast("int"))
    of_result, modified = result.request, result.modified
    describe = lambda book_id, told, cover: described(book_id, told, cover, of_result, modified)
    first = F.least("page_ord", F.lit(0))  # the info row, the cover, pages
    try:
        stage = stage or shelf.open_stage(folder)
        made = shelf.staged(result.parts, of_result.options.output, stage, describe, [first, *reading_order(of_result.options.webtoon)[:-1], F.col("piece_ord"), F.col("chapter_path")])
        return shelf.write(made.join(names, "book_id"), folder, stage, keep)
    except shelf.PlanError as e:
        raise ConversionError(e.code, str(e)) from e


def publish(result: Result, folder: str, request: Request) -> list[dict]:
    """Publishes the books (see `written`); events in order of the books, numbered without a gap: a small row for each book."""
    events = [{"type": "started"}]
    for r in sorted(written(result, folder, request).collect(), key=lambda r: natural.path_key(r["book_id"])):
        if r["error"]:
            events.append({"type": "error", "code": r["error"].split(":")[0], "book": r["book_id"], "message": r["error"]})
        else:
            events.append({"type": "completed", "book": r["book_id"], "path": r["path"], "bytes": r["bytes"], "pages": r["pages"]})
    return [{"sequence": i, **e} for i, e in enumerate(events)]


def report(events: list[dict], issues: list) -> str:
    """What happened, for people: issues by book, then the books written."""
    lines = [f"{i['book_id']}: {i['code']}" + (f" ({i['diagnostic']})" if i["diagnostic"] else "") + (f" at {i['path']}" if i["path"] else "") for i in issues]
    lines += [f"{e['book']} -> {e['path']} ({e['pages']} pages, {e['bytes']} bytes)" if e["type"] == "completed" else f"{e['book']}: {e['message']}" for e in events if e["type"] != "started"]
    return "\n".join(lines)


def natural_entries(df: DataFrame) -> DataFrame:
    """Entries in natural order of their paths, equal keys by their scan order."""
    return df.withColumn("_key", natural.natural_key("rel_path")).orderBy("book_id", "_key", "ord").drop("_key")
