"""Publication of books in stages: destinations are planned and checked before page work, tasks write to a stage beside them, and the
commit gives each file its name without ever taking another's. An aborted job leaves nothing behind.

The destination can be on any file system that Python workers know (local and mounted folders, HDFS, object stores). On local ones a name is
taken by a hard link, which is atomic; elsewhere by a check and a move.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioloom.functions import text
from folioloom.sources.archives import located

from . import books

NAME = "folioloom_shelf"
STAGE = f".{books.NAME}-"
WRITTEN = "book_id string, path string, bytes long, pages int, error string"


class PlanError(ValueError):
    """A destination that can't be used; `code` says at which step."""

    def __init__(self, message: str, code: str = "output_plan_failed"):
        self.code = code
        super().__init__(message)


def is_valid_name(name: str) -> bool:
    """As `text.is_valid_name`, for one name."""
    stem = name.split(".", 1)[0].rstrip(" ").lower()
    return 0 < len(name.encode()) <= 255 and not any(c < " " or c in '\x7f<>:"/\\|?*' for c in name) and name[-1] not in ". " and stem not in text.DEVICE_NAMES


def split(output: str, is_folder: bool) -> tuple[str, str | None]:
    """A folder and, where a file of a known ending was asked for, its name."""
    named = not is_folder and output.lower().endswith((".epub", ".cbz", ".pdf"))
    return (posixpath.dirname(output.rstrip("/")) or ".", posixpath.basename(output)) if named else (output.rstrip("/") or "/", None)


def check(output: str) -> tuple[str, str | None]:
    """The folder and the name asked for (null: names follow from the books), once everything that needs no writing is checked."""
    from pyarrow import fs

    try:
        system, inner = located(output)
    except (pa.ArrowException, OSError, ValueError) as e:
        raise PlanError(f"no file system for {output}: {e}") from e
    if not all(len(part.encode()) <= 255 for part in inner.split("/")):
        raise PlanError(f"a name too long: {output}")
    folder, name = split(output, system.get_file_info(inner).type == fs.FileType.Directory)
    if name is not None and not is_valid_name(name):
        raise PlanError(f"no valid name: {name}")
    inner = located(folder)[1]
    at = inner
    while (found := system.get_file_info(at).type) == fs.FileType.NotFound:
        if not is_valid_name(posixpath.basename(at)):
            raise PlanError(f"no valid folder: {at}")
        above = posixpath.dirname(at)
        if above == at:
            break
        at = above
    if found == fs.FileType.File:
        raise PlanError(f"{at} is no folder")
    return folder, name


def taken(spark: SparkSession, folder: str) -> DataFrame:
    """name of everything in a folder that is there."""
    from pyarrow import fs

    system, inner = located(folder)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return spark.createDataFrame([(f.base_name,) for f in found], "name string")


def planned(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds to book_id and name: `turn`, its place among books of one name, `output`, the first free name for it, and `occupied`, whether its own was not free.

    names: book_id and name. Names differ regardless of case. Of a name, as many numbers are looked at as it has books and files.
    """
    mark = rf" \({books.NAME}(?: ([0-9]+))?\)(?=(\.kepub\.epub|\.[^.]*)$)"
    number = F.when(F.rlike("name", F.lit(mark)), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(name, r'{mark}', 1), '') AS int)"), F.lit(1))).otherwise(0)
    used = existing.select(F.lower(F.regexp_replace("name", mark, "")).alias("_key"), number.alias("_n")).groupBy("_key").agg(F.collect_set("_n").alias("_used"))
    turn = (F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("book_id")) - 1).cast("int")
    rows = names.withColumn("turn", turn).withColumn("_key", F.lower("name")).join(used, "_key", "left")
    rows = rows.withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.element_at(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_used") + F.col("turn")), F.col("_used"))), F.col("turn") + 1)
    stem = F.regexp_replace("name", r"(\.kepub\.epub|\.[^.]*)$", "")
    ending = F.regexp_extract("name", r"(\.kepub\.epub|\.[^.]*)$", 1)
    output = F.when(free == 0, F.col("name")).when(free == 1, F.concat(stem, F.lit(f" ({books.NAME})"), ending)).otherwise(F.concat(stem, F.lit(f" ({books.NAME} "), free.cast("string"), F.lit(")"), ending))
    return rows.select("book_id", "name", "turn", output.alias("output"), F.array_contains("_used", 0).alias("occupied"))


def open_stage(folder: str) -> str:
    """A new stage in a folder, which is made if it isn't there: proof, before any page work, that books can be written."""
    stage = f"{folder}/{STAGE}{uuid.uuid4().hex}"
    system, inner = located(stage)
    try:
        system.create_dir(inner, recursive=True)
    except (pa.ArrowException, OSError) as e:
        raise PlanError(f"{folder} can't be made or written: {e}", "output_directory_create_failed") from e
    return stage


def close_stage(stage: str) -> None:
    from pyarrow import fs

    system, inner = located(stage)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


def _same(system, a: str, b: str) -> bool:
    """Whether two files hold the same bytes."""
    infos = system.get_file_info([a, b])
    if not all(i.is_file for i in infos) or infos[0].size != infos[1].size:
        return False
    with system.open_input_stream(a) as x, system.open_input_stream(b) as y:
        while True:
            p, q = x.read(1 << 20), y.read(1 << 20)
            if p != q or not p:
                return p == q


def _take(system, staged: str, final: str) -> bool:
    """Gives a staged file a name, if the name is free."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        try:
            os.link(staged, final)
        except FileExistsError:
            return False
        os.unlink(staged)
        return True
    if system.get_file_info(final).type != fs.FileType.NotFound:
        return False
    system.move(staged, final)
    return True


def secure(system, path: str) -> None:
    """A local file is on disk before it gets its name."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb+") as f:
            os.fsync(f.fileno())


def publish(system, folder: str, staged: str, name: str, turn: int) -> str:
    """The path that a staged file got: the first free name from that of its turn on. A file of that very name with the same bytes is this book, from an earlier attempt."""
    n = turn
    while True:
        final = posixpath.join(folder, books.alternate(name, n))
        if _take(system, staged, final):
            return final
        if n == turn and _same(system, staged, final):
            system.delete_file(staged)
            return final
        n += 1


@dataclass
class Staged(WriterCommitMessage):
    """Of each book of a task: book_id, name, turn, staged file (null: the book failed), bytes, pages, error."""

    rows: list[tuple]


class Shelf(DataSource):
    """Options: folder, stage. Rows: book_id, name, turn, bytes, pages, content (or `staged`: a file of the stage), error."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.stage = options["folder"], options["stage"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, inner = located(self.stage)
        rows = []
        for batch in iterator:
            for i in range(batch.num_rows):
                get = lambda c, i=i: batch.column(c)[i].as_py()  # noqa: E731, B023
                staged, error = None, get("error")
                if error is None and "staged" in batch.schema.names:
                    staged = f"{inner}/{get('staged')}"
                elif error is None:
                    staged = f"{inner}/{uuid.uuid4().hex}"
                    try:
                        with system.open_output_stream(staged) as f:
                            f.write(batch.column("content")[i].as_buffer())
                        secure(system, staged)
                    except (pa.ArrowException, OSError) as e:
                        staged, error = None, f"output_write_failed: {e}"
                rows.append((get("book_id"), get("name"), get("turn"), staged, get("bytes"), get("pages"), error))
        return Staged(rows)

    def commit(self, messages: list[Staged | None]) -> None:
        system, inner = located(self.folder)
        lines = []
        for book, name, turn, staged, size, pages, error in sorted((r for m in messages if m for r in m.rows), key=lambda r: (r[1], r[2])):
            path = None
            if staged is not None:
                try:
                    path = publish(system, inner, staged, name, turn)
                except (pa.ArrowException, OSError) as e:
                    error = f"output_write_failed: {e}"
            lines.append(json.dumps({"book_id": book, "path": path, "bytes": size, "pages": pages, "error": error}, ensure_ascii=False))
        with system.open_output_stream(f"{located(self.stage)[1]}/report.json") as f:
            f.write("\n".join(lines).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        close_stage(self.stage)


STAGED = "book_id string, staged string, bytes long, pages int, error string"


class _Book:
    """A book that is being written to the stage while its rows pass by: what tells of it, its cover, then its pages."""

    def __init__(self, system, inner: str, book_id: str, kind: type, describe: Callable):
        self.system, self.inner, self.book_id, self.kind, self.describe = system, inner, book_id, kind, describe
        self.told, self.cover, self.pages, self.size, self.error = None, None, 0, 0, None
        self.file, self.staged, self.writer = None, None, None

    def _guarded(self, step: Callable) -> None:
        if self.error is None:
            try:
                step()
            except ValueError as e:
                self.error = f"book_build_failed: {e}"
            except (pa.ArrowException, OSError) as e:
                self.error = f"output_write_failed: {e}"

    def _begin(self) -> None:
        if self.writer is None:
            self.staged = uuid.uuid4().hex
            self.file = self.system.open_output_stream(f"{self.inner}/{self.staged}")
            self.writer = self.kind(self.file, self.describe(self.book_id, self.told, self.cover))

    def _add(self, row: dict) -> None:
        self._begin()
        self.writer.add(books.Page(row["chapter_path"], row["ext"], row["content"], row["role"], bool(row["black_background"]), row["piece_ord"] > 0))

    def row(self, row: dict) -> None:
        if row["role"] == "info":
            self.told = self.told or row
        elif row["error"] is not None:
            pass  # a row of the issues
        elif row["role"] == "cover":
            self.cover = self.cover or row["content"]
        elif row["page_ord"] >= 0:
            self.pages += 1
            self._guarded(lambda: self._add(row))

    def _end(self) -> None:
        self._begin()
        self.size = self.writer.finish()
        self.file.close()
        secure(self.system, f"{self.inner}/{self.staged}")

    def finish(self) -> tuple:
        self._guarded(self._end)
        self.close()
        return self.book_id, self.staged if self.error is None else None, self.size if self.error is None else 0, self.pages, self.error

    def close(self) -> None:
        if self.file is not None and not self.file.closed:
            self.file.close()


def staged(parts: DataFrame, fmt: str, stage: str, describe: Callable, order: list[Column]) -> DataFrame:
    """Books written to a stage page by page; rows of STAGED, one for each book.

    parts: rows as of pages (`pages.OUTPUT`), with `info` and `cover` rows first in `order`. describe: (book_id, the info row or
    null, the cover's bytes or null) -> BookInfo. The only shuffle is by book; a task sorts its books, with spills, and holds one batch of
    rows and what a table of contents tells, so a book may be larger than memory, a row or 2 GiB. A task that runs again writes other
    files; those of lost attempts go with the stage. A book of which no page is left has an error. Null or empty bytes of a page are what its format makes of them.
    """
    names = ["book_id", "chapter_path", "page_ord", "piece_ord", "role", "ext", "height", "black_background", "content", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = located(stage)
        done = lambda told: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(told, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["book_id", "staged", "bytes", "pages", "error"])
        book = None
        try:
            for batch in batches:
                columns = [batch.column(n) for n in names]
                for i in range(batch.num_rows):
                    row = {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}
                    if book is not None and book.book_id != row["book_id"]:
                        yield done(book.finish())
                        book = None
                    book = book or _Book(system, inner, row["book_id"], books.WRITERS[fmt], describe)
                    book.row(row)
            if book is not None:
                yield done(book.finish())
        finally:
            if book is not None:
                book.close()

    return parts.repartition("book_id").sortWithinPartitions("book_id", *order).select(*names).mapInArrow(run, STAGED)


def make_folder(path: str) -> None:
    system, inner = located(path)
    system.create_dir(inner, recursive=True)


def write(made: DataFrame, folder: str, stage: str | None = None, keep: bool = False) -> DataFrame:
    """Stages and publishes books (rows as of `Shelf`); rows of WRITTEN, one for each book. `stage`: one that was opened before; it is closed here unless it is to be kept."""
    spark = made.sparkSession
    spark.dataSource.register(Shelf)
    stage = stage or open_stage(folder)
    try:
        made.select("book_id", "name", F.col("turn").cast("int").alias("turn"), F.col("bytes").cast("long").alias("bytes"), F.col("pages").cast("int").alias("pages"), "staged" if "staged" in made.columns else "content", "error").write.format(NAME).mode("append").option("folder", folder).option("stage", stage).save()
        system, inner = located(stage)
        with system.open_input_stream(f"{inner}/report.json") as f:
            told = [json.loads(line) for line in f.read().decode().splitlines()]
    finally:
        if not keep:
            close_stage(stage)
    return spark.createDataFrame([(r["book_id"], r["path"], r["bytes"], r["pages"], r["error"]) for r in told], WRITTEN)
