"""Book scans: folders and ZIP archives as entries, one row a file, with the filter pushed below decompression.

Names are tested before a member is inflated or a file is read; reads are bounded; entries come in natural order. A ZIP
whose pages all lie under one top folder, some of them directly in it, is read as if that folder were its root.
"""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import natural, text

from .images import MAX_BYTES

INFO = "ComicInfo.xml"
SCHEMA = "book_id string, rel_path string, ord long, length long, content binary, issue string"


def wanted(path: str) -> bool:
    parts = path.split("/")
    name = parts[-1]
    ext = name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""
    return ext in text.IMAGE_EXTENSIONS and "__MACOSX" not in parts and not name.startswith("._") or name == INFO


def settle(paths: list[str]) -> tuple[list[str | None], int]:
    """Paths after the wrapper folder is taken off (null: ignored), and the number ignored."""
    pages = [p for p in paths if p.rsplit("/", 1)[-1] != INFO]
    tops = {p.split("/", 1)[0] if "/" in p else "" for p in pages}
    top = next(iter(tops)) if len(tops) == 1 else ""
    strip = f"{top}/" if top and any(p.count("/") == 1 for p in pages) else ""
    own_info = INFO in paths
    out: list[str | None] = []
    for p in paths:
        inner = p[len(strip) :] if strip and p.startswith(strip) else p
        if p.rsplit("/", 1)[-1] == INFO:
            inner = INFO if p == INFO or strip and not own_info and inner == INFO else None
        out.append(inner)
    return out, out.count(None)


def _members(content: bytes, book: str, every: bool) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            names = [i.filename.replace("\\", "/") for i in infos]
            keep = [i for i, n in enumerate(names) if every or wanted(n)]
            paths, ignored = (names, 0) if every else settle([names[i] for i in keep])
            placed = sorted(((path, i) for i, path in zip(keep, paths, strict=True) if path is not None), key=lambda x: natural.path_key(x[0]))
            for n, (path, i) in enumerate(placed):  # one member at a time
                length, data, issue = infos[i].file_size, None, None
                try:
                    if length <= MAX_BYTES:
                        with z.open(infos[i]) as f:
                            data = f.read(MAX_BYTES + 1)
                        length = len(data)
                    if length > MAX_BYTES:
                        data, issue = None, "too_large"
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
                    data, issue = None, f"input_read_failed: {e}"
                yield book, path, n, length, data, issue
            skipped = len(infos) - len(keep) + ignored
            if skipped:
                yield book, None, None, skipped, None, "skipped_non_images"
    except zipfile.BadZipFile as e:
        yield book, None, None, None, None, f"input_read_failed: {e}"


def _expand(every: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["book_id", "rel_path", "ord", "length", "content", "issue"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for row in _members(bytes(content), path, every):
                    rows.append(row)
                    size += len(row[4] or b"")
                    if size > 32 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    return run


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"ord": "Int64", "length": "Int64"})


def zip_entries(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """Entries of the archives (.cbz, .zip) at or below a path; archives are dealt over partitions. every: all members, in natural order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{cbz,zip,CBZ,ZIP}").load(path)
    return files.select("path", "content").mapInPandas(_expand(every), SCHEMA)


def folder_entries(spark: SparkSession, path: str, book_id: str | None = None) -> DataFrame:
    """Entries of a folder of any depth, with `issue`: too_large (the content is not read) and link_skipped (a link that leads out of a local folder)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.sub("^file:/*", "/", path).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/"), f"^{re.escape('/' + root.lstrip('/'))}/", "")
    named = lambda df, content, issue: df.select(F.lit(book_id or os.path.basename(root)).alias("book_id"), rel.alias("rel_path"), "length", content.alias("content"), issue.alias("issue"))
    rows = named(files.where(F.col("length") <= MAX_BYTES), F.col("content"), F.lit(None).cast("string"))
    rows = rows.unionByName(named(files.where(F.col("length") > MAX_BYTES), F.lit(None).cast("binary"), F.lit("too_large")))
    if os.path.isdir(root):  # links are a matter of local folders
        refused = dict(linked_files(root)[1])
        if refused:
            top = lambda link: (F.col("rel_path") == link) | F.startswith("rel_path", F.lit(f"{link}/"))
            for link in refused:
                rows = rows.where(~top(link))
            links = spark.createDataFrame([(book_id or os.path.basename(root), link, f"link_skipped: {why}") for link, why in refused.items()], "book_id string, rel_path string, issue string")
            rows = rows.unionByName(links.select("book_id", "rel_path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"), "issue"))
    page = text.is_page_image(F.col("rel_path")) | (F.col("rel_path") == INFO) | F.coalesce(F.startswith("issue", F.lit("link_skipped")), F.lit(False))
    return rows.where(page).withColumn("key", natural.natural_key("rel_path"))


def linked_files(root: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Files of a local folder, links followed only to files inside it: relative paths, and (link, reason) of those refused."""
    real = os.path.realpath(root)
    kept, refused = [], []
    for folder, inner, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            rel = os.path.relpath(path, root)
            if not wanted(rel.replace(os.sep, "/")):
                continue
            if os.path.islink(path):
                to = os.path.realpath(path)
                reason = "unresolved" if not os.path.exists(to) else "outside_input" if os.path.commonpath([real, to]) != real else None if os.path.isfile(to) else "not_a_file"
                if reason:
                    refused.append((rel, reason))
                    continue
            kept.append(rel)
        for name in inner:
            path = os.path.join(folder, name)
            if os.path.islink(path):
                refused.append((os.path.relpath(path, root), "not_a_file"))
    return sorted(kept, key=natural.path_key), sorted(refused, key=lambda r: natural.path_key(r[0]))


def text_of(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8 with what is not replaced."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            body = data[2:]
            return body[: len(body) // 2 * 2].decode(name, "replace")
    return data.decode("utf-8", "replace")


def comic_info(xml: str) -> dict:
    """Metadata of an archive; raises ValueError if the text is no XML."""
    try:
        root = ET.fromstring(xml.encode())
    except ET.ParseError as e:
        raise ValueError(str(e)) from e
    first = lambda tag: next((v for e in root.iter(tag) if (v := (e.text or "").strip())), None) if root.find(f".//{tag}") is not None else None
    people = lambda tag: sorted({p.strip() for p in (first(tag) or "").split(", ") if p.strip()})
    marks = [(int(p.get("Image")), p.get("Bookmark")) for p in root.iter("Page") if (p.get("Image") or "").isdigit() and p.get("Bookmark")]
    return {**{k: first(k.capitalize()) for k in ("series", "volume", "number", "title", "summary")}, **{k: people(t) for k, t in (("writers", "Writer"), ("pencillers", "Penciller"), ("inkers", "Inker"), ("colorists", "Colorist"))}, "bookmarks": marks}
