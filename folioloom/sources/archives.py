"""Books as a data source: archives and folders of pages, each member read once, by the task that works on it.

A partition is a range of bytes of an archive's members, of several small archives, or of a folder's pages. The driver lists files and looks
at their sizes; a task reads an archive's directory from its end and then only the members of its own range, so an archive of any size is
dealt over many tasks, and nothing is shuffled or held whole. Names are tested before a member is opened.

`zip` in a name's ending, in any case, makes a file below a folder an archive, as do the first bytes of a file without an ending; a path
that is itself a file is opened as an archive whatever its name. Pages in a folder beside archives are a book of the folder's own.
"""

from __future__ import annotations

import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioloom.functions import natural

from . import entries, images

NAME = "folioloom_books"
#: width and height are those of the header, where it has any; is_first marks a book's first page that can be read.
ENTRIES = "book_id string, rel_path string, ord long, length long, is_first boolean, width int, height int, content binary, issue string"
_ARROW = pa.schema([("book_id", pa.string()), ("rel_path", pa.string()), ("ord", pa.int64()), ("length", pa.int64()), ("is_first", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("issue", pa.string())])
#: Folder beside books that holds covers; endings of archives; bytes of a batch and of a header.
COVERS, ENDINGS, BATCH, HEAD = "Covers", (".cbz", ".zip"), 32 << 20, 1 << 18
#: Bytes of a partition at most, and at least.
MOST, LEAST = 64 << 20, 1 << 18
_STARTS = (b"PK\x03\x04", b"PK\x05\x06")


def located(path: str):
    """The file system of a path and the path in it. Schemes that only Spark knows raise an error."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def named(path: str) -> str:
    """A path as Spark's own sources name it."""
    inner = re.sub("^file:/*", "/", path)
    return path.rstrip("/") if "://" in inner else f"file:{os.path.abspath(inner)}"


def readable(path: str) -> bool:
    """Whether Python workers can read a path by ranges."""
    try:
        system, inner = located(path)
        return system.get_file_info(inner).type.name != "NotFound"
    except (pa.ArrowException, OSError, ValueError):
        return False


@dataclass
class Piece:
    """The `part`-th of `parts` equal ranges of an archive's or a folder's members."""

    path: str
    book: str
    part: int
    parts: int
    folder: bool


@dataclass
class Share(InputPartition):
    pieces: list[Piece]

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class Books(DataSource):
    """Options: path; slices (partitions wished for); content (false: sizes and names only); every (all members of archives); max_bytes of a member."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def _listed(system, root: str) -> list[tuple[str, int]]:
    """Files below a folder (path relative to it, size), but hidden ones; links of local folders are followed to files inside it only."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        out = []
        for folder, inner, names in os.walk(root):
            inner[:] = sorted(n for n in inner if not n.startswith("."))
            for name in names:
                full = os.path.join(folder, name)
                if os.path.islink(full) and os.path.commonpath([os.path.realpath(root), os.path.realpath(full)]) != os.path.realpath(root):
                    continue
                if os.path.isfile(full) and (not name.startswith(".") or name.startswith("._")):
                    out.append((os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)))
        return out
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    rel = lambda f: f.path[len(root.rstrip("/")) + 1 :]
    return [(rel(f), f.size) for f in found if f.is_file and not any(p.startswith(".") and not p.startswith("._") for p in rel(f).split("/"))]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.slices = int(options.get("slices", 1))
        self.content = options.get("content", "true").lower() == "true"
        self.every = options.get("every", "false").lower() == "true"
        self.most = int(options.get("max_bytes", images.MAX_BYTES))

    def _parts(self, listed: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]], int]:
        """Archives, loose pages and the number of other files of a folder."""
        system, root = located(self.path)
        archives, loose, others = [], [], 0
        for rel, size in listed:
            name = rel.rsplit("/", 1)[-1]
            if name.lower().endswith(ENDINGS):
                archives.append((rel, size))
            elif entries.wanted(rel) and (rel == entries.INFO or name != entries.INFO):
                loose.append((rel, size))
            elif "." not in name and size >= 22 and self._starts(system, f"{root}/{rel}"):
                archives.append((rel, size))
            elif not name.endswith(".json"):
                others += 1
        if archives:
            loose = [(r, n) for r, n in loose if not r.startswith(f"{COVERS}/")]
        return archives, loose, others

    @staticmethod
    def _starts(system, path: str) -> bool:
        with system.open_input_file(path) as f:
            return f.read(4) in _STARTS

    def partitions(self) -> list[Share]:
        system, root = located(self.path)
        if not system.get_file_info(root).type.name == "Directory":
            archives, loose, others = [(None, system.get_file_info(root).size)], [], 0
        else:
            archives, loose, others = self._parts(_listed(system, root))
        whole = sum(n for _, n in archives) + sum(n for _, n in loose)
        size = min(MOST, max(LEAST, whole // max(1, self.slices)))
        shares: list[Share] = []
        room = 0
        base = named(self.path)
        cut = lambda n: max(1, -(-n // size))
        pages = sum(n for _, n in loose)
        for path, book, n, folder in [*((base if r is None else f"{base}/{r}", base if r is None else f"{base}/{r}", n, False) for r, n in archives), *([(base, os.path.basename(base), pages, True)] if loose or others or not archives else [])]:
            parts = cut(n)
            if shares and parts == 1 and n <= room:
                shares[-1].pieces.append(Piece(path, book, 0, 1, folder))
                room -= n
            else:
                shares += [Share([Piece(path, book, i, parts, folder)]) for i in range(parts)]
                room = size - n if parts == 1 else 0
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for piece in partition.pieces:
            for row in (self._folder if piece.folder else self._archive)(piece):
                rows.append(row)
                size += len(row[7] or b"")
                if size > BATCH or len(rows) >= 4096:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def _range(self, piece: Piece, sizes: list[int]) -> range:
        """The members of a piece: those whose first byte, all laid end to end, lies in its range. Members without bytes count one."""
        ends = list(accumulate(max(1, n) for n in sizes))
        whole = ends[-1] if ends else 1
        owner = [(e - max(1, n)) * piece.parts // whole for e, n in zip(ends, sizes, strict=True)]
        return range(sum(o < piece.part for o in owner), sum(o <= piece.part for o in owner))

    def _row(self, book: str, path: str, number: int, length: int, data: bytes | None, issue: str | None, first: bool) -> tuple:
        size = images.dimensions(data) if data is not None else None
        return (book, path, number, min(length, 2**63 - 1), first, *(size or (None, None)), data if self.content or path == entries.INFO else None, issue)

    def _rows(self, piece: Piece, members: list[tuple[str, int]], sizes: list[int], read) -> Iterator[tuple]:
        """Rows of a piece's members (path, length), in natural order. `read` gives a member's bytes, or raises what tells why it can't."""
        waiting = piece.part == 0  # a book's first pages lie in its first piece
        for n in self._range(piece, sizes):
            path, length = members[n]
            data, issue = None, None
            if length > self.most:
                issue = "too_large"
            else:
                try:
                    data = read(n)
                    length = len(data)
                    if length > self.most:
                        data, issue = None, "too_large"
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, ValueError) as e:
                    issue = f"input_read_failed: {e}"
            first = waiting and data is not None and path != entries.INFO
            waiting = waiting and not first
            yield self._row(piece.book, path, n, length, data, issue, first)

    def _archive(self, piece: Piece) -> Iterator[tuple]:
        system, inner = located(piece.path)
        try:
            with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                names = [i.filename.replace("\\", "/") for i in infos]
                keep = [i for i, n in enumerate(names) if self.every or entries.wanted(n)]
                paths, ignored = (names, 0) if self.every else entries.settle([names[i] for i in keep])
                placed = sorted(((path, infos[i]) for i, path in zip(keep, paths, strict=True) if path is not None), key=lambda x: natural.path_key(x[0]))

                def inflate(n: int) -> bytes:
                    with z.open(placed[n][1]) as member:
                        whole = self.content or placed[n][0] == entries.INFO
                        data = member.read(self.most + 1 if whole else HEAD)
                        return data if whole or images.dimensions(data) else data + member.read(self.most + 1 - len(data))

                yield from self._rows(piece, [(p, i.file_size) for p, i in placed], [i.compress_size for _, i in placed], inflate)
                skipped = len(infos) - len(keep) + ignored
                if skipped and piece.part == 0:
                    yield (piece.book, None, None, skipped, False, None, None, None, "skipped_non_images")
                if not infos and piece.part == 0:
                    yield (piece.book, None, None, None, False, None, None, None, "input_empty")
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            if piece.part == 0:
                yield (piece.book, None, None, None, False, None, None, None, f"input_read_failed: {e}")

    def _folder(self, piece: Piece) -> Iterator[tuple]:
        system, root = located(piece.path)
        archives, loose, others = self._parts(_listed(system, root))
        loose = sorted(loose, key=lambda x: natural.path_key(x[0]))

        def load(n: int) -> bytes:
            with system.open_input_file(f"{root}/{loose[n][0]}") as f:
                data = f.read(self.most + 1 if self.content or loose[n][0] == entries.INFO else HEAD)
                return data if self.content or images.dimensions(data) else data + f.read(self.most + 1 - len(data))

        yield from self._rows(piece, loose, [n for _, n in loose], load)
        if piece.part:
            return
        if others:
            yield (piece.book, None, None, others, False, None, None, None, f"skipped_non_images{': beside archives' * bool(archives)}")
        if not loose and not others:
            yield (piece.book, None, None, None, False, None, None, None, "input_empty")
        if os.path.isdir(root):
            for link, why in entries.linked_files(root)[1]:
                yield (piece.book, link, None, None, False, None, None, None, f"link_skipped: {why}")


def books(spark: SparkSession, path: str, content: bool = True, every: bool = False) -> DataFrame:
    """Entries (see ENTRIES) of an archive, of a folder of pages, or of a folder of archives with any pages beside them."""
    spark.dataSource.register(Books)
    slices = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(NAME).option("slices", slices).option("content", content).option("every", every).option("max_bytes", entries.MAX_BYTES).load(path)
