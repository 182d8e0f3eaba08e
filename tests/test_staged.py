"""Books written page by page: the same bytes as books made whole, of any size, in reading order."""

import io
import os
import re
import zipfile

import numpy as np
import pytest

from folioloom import api
from folioloom.operators import pages as P
from folioloom.sinks import books, images, shelf

PNG, JPG = images.png(np.full((20, 10), 9, np.uint8)), images.jpeg(np.zeros((16, 16), np.uint8), 80)
FIELDS = [f.split()[0] for f in P.OUTPUT.split(", ")]


def _row(book, chapter, at, content, ext="png", role="normal", error=None, piece=0):
    return dict(zip(FIELDS, (book, chapter, at, piece, role, ext, 10, 20, False, False, content, error), strict=True))


def _staged(spark, rows, fmt, folder, n=3):
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], P.OUTPUT).repartition(n)
    found = shelf.staged(df, fmt, str(folder), lambda book_id, told, cover: books.BookInfo(title=book_id, cover=cover), ["page_ord", "piece_ord", "chapter_path"]).collect()
    assert len({r.book_id for r in found}) == len(found)
    return {r.book_id: r for r in found}


@pytest.mark.parametrize("fmt", ["cbz", "epub", "pdf"])
def test_bytes_are_those_of_books_made_whole(spark, tmp_path, fmt):
    rows = [_row("made", "", -1, b"cover", "jpg", "cover"), _row("failed cover", "", -1, None, None, "cover", "cover_build_failed: x")]
    for book in ("made", "failed cover", *(f"b{i}" for i in range(12))):  # several books for a task; chapters that are mixed
        rows += [_row(book, f"c{i % 3}", i, (PNG, JPG)[i % 2], ("png", "jpg")[i % 2]) for i in range(11)]
        rows += [_row(book, "c1", 4, PNG, piece=1), _row(book, "c1", 50, None, error="page_processing_failed: x")]
    rows += [_row("no page", "c", 0, None, error="page_processing_failed: x"), _row("no page", "{}", -2, None, "xml", "info"), _row("odd", "c", 0, b"no image", "tif")]
    found = _staged(spark, rows, fmt, tmp_path)
    assert len(found) == 16
    for book, r in found.items():
        own = sorted((x for x in rows if x["book_id"] == book and x["error"] is None and x["page_ord"] >= 0), key=lambda x: (x["page_ord"], x["piece_ord"]))
        pages = [books.Page(x["chapter_path"], x["ext"], x["content"], x["role"], continues=x["piece_ord"] > 0) for x in own]
        assert r.pages == len(own)
        if book == "no page" or book == "odd" and fmt != "cbz":
            assert r.error.startswith("book_build_failed: ") and (r.staged, r.bytes) == (None, 0)
            continue
        want = books.BUILDERS[fmt](pages, books.BookInfo(title=book, cover=b"cover" if book == "made" else None))
        with open(tmp_path / r.staged, "rb") as f:
            assert f.read() == want and r.bytes == len(want)
    again = _staged(spark, rows, fmt, tmp_path, 7)
    assert {b: (r.bytes, r.pages, r.error) for b, r in again.items()} == {b: (r.bytes, r.pages, r.error) for b, r in found.items()}


def test_no_rows_are_no_books(spark, tmp_path):
    assert _staged(spark, [], "cbz", tmp_path) == {} and os.listdir(tmp_path) == []


class Sparse(io.RawIOBase):
    """A file in which long rests of writes are holes."""

    def __init__(self, path):
        self.file, self.largest = open(path, "wb"), 0  # noqa: SIM115

    def write(self, data):
        self.largest = max(self.largest, len(data))
        start = self.file.tell()
        if len(data) > 1 << 20 and not any(memoryview(data)[4096 : 1 << 16]):
            self.file.write(data[:4096])
            self.file.seek(start + len(data) - 4096)
            self.file.write(data[-4096:])
        else:
            self.file.write(data)
        return len(data)


BIG = 1 << 26


@pytest.mark.parametrize("fmt", ["epub", "pdf"])
def test_books_of_more_than_two_gibibytes(tmp_path, fmt):
    sink = Sparse(tmp_path / "book")
    writer = books.WRITERS[fmt](sink, books.BookInfo(title="big"))
    page = JPG + bytes(BIG - len(JPG))
    for i in range(33):
        writer.add(books.Page(f"c{i // 10}", "jpg", page))
    size = writer.finish()
    sink.file.close()
    assert size == os.path.getsize(tmp_path / "book") > 2**31 and sink.largest < BIG + 4096
    with open(tmp_path / "book", "rb") as f:
        if fmt == "epub":
            z = zipfile.ZipFile(f)
            assert sum(n.endswith(".jpg") for n in z.namelist()) == 33 and z.testzip() is None
            assert z.read("OEBPS/content.opf").count(b"<itemref ") == 33 and z.getinfo("OEBPS/toc.ncx").header_offset > 2**31
            return
        f.seek(-3000, 2)
        end = f.read()
        start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", end)[1])
        f.seek(start)
        places = [int(m) for m in re.findall(rb"(\d{10}) 00000 n ", f.read())]
        for number in (1, 2, 3, 99, len(places)):
            f.seek(places[number - 1])
            assert f.read(20).startswith(f"{number} 0 obj\n".encode())
        f.seek(places[1])
        assert b"/Count 33/" in f.read(100)
    os.unlink(tmp_path / "book")


def test_a_pdf_says_where_it_ends():
    writer = books.Pdf(io.BytesIO(), books.BookInfo())
    writer.size = 10**10
    with pytest.raises(ValueError, match="10\\^10"):
        writer.add(books.Page("c", "jpg", JPG))


def test_chapters_of_a_webtoon_are_in_natural_order(spark, tmp_path):
    strip = np.full((2000, 800), 255, np.uint8)
    for at in range(0, 2000, 400):
        strip[at + 30 : at + 330, 40:760] = 90
    with zipfile.ZipFile(tmp_path / "tale.cbz", "w") as z:
        for chapter in (10, 2, 1):
            z.writestr(f"Chapter {chapter}/1.png", images.png(strip))
    request = api.Request(options=P.PageOptions(profile="KoC", format="cbz", webtoon=True))
    result = api.convert(spark, str(tmp_path), request)
    path = api.written(result, str(tmp_path / "out"), request).first().path
    with zipfile.ZipFile(path) as z:
        folders = list(dict.fromkeys(n.split("/")[0] for n in z.namelist() if "/" in n))
    with zipfile.ZipFile(io.BytesIO(bytes(result.books.first().content))) as z:
        assert list(dict.fromkeys(n.split("/")[0] for n in z.namelist() if "/" in n)) == folders == ["Chapter 1", "Chapter 2", "Chapter 10"]
    result.release()
