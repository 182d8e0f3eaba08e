"""Scans, natural order, metadata and books as files."""

import io
import os
import random
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest

from folioloom import profiles
from folioloom.functions import natural
from folioloom.operators import pages as operator
from folioloom.sinks import books, images
from folioloom.sources import entries

PIXELS = images.png(np.arange(32 * 48, dtype=np.uint8).reshape(48, 32))


def _zip(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in names:
            z.writestr(name, data)
    return out.getvalue()


def test_natural_order():
    want = ["cover.png", "p2.png", "p07.png", "p10.png", "p10 (2).png", "zz-credits.png", "Chapter 1/001.png", "Chapter 1/002.png", "Chapter 2/001.png", "Chapter 10/001.png"]
    mixed = want[:]
    random.Random(0).shuffle(mixed)
    assert sorted(mixed, key=natural.path_key) == want
    assert natural.path_key("p007.png") == natural.path_key("P7.png")
    assert natural.path_key("1２.png") == natural.path_key("12.png")
    assert natural.path_key("p01.png") < natural.path_key("P1 (2).png")
    found = {n: natural.extensions(n)[1] for n in ("a.tar.gz", "a.b.c.d.png", "a.5.png", "a.longer", ".png", "Vol. 1")}
    assert found == {"a.tar.gz": [".tar", ".gz"], "a.b.c.d.png": [".d", ".png"], "a.5.png": [".png"], "a.longer": [], ".png": [], "Vol. 1": [". 1"]}


def test_zip_scan(spark, tmp_path):
    info = "<ComicInfo><Series>S</Series></ComicInfo>"
    (tmp_path / "a.cbz").write_bytes(_zip([("Wrap/p10.png", PIXELS), ("Wrap/p2.png", PIXELS), ("Wrap/ComicInfo.xml", info), ("Wrap/notes.txt", "x"), ("__MACOSX/Wrap/p2.png", "x"), ("Wrap/._p2.png", "x")]))
    (tmp_path / "b.cbz").write_bytes(b"no archive")
    rows = entries.zip_entries(spark, str(tmp_path)).collect()
    good = sorted((r.ord, r.rel_path) for r in rows if r.book_id.endswith("a.cbz") and r.rel_path)
    assert good == [(0, "ComicInfo.xml"), (1, "p2.png"), (2, "p10.png")]
    assert {(r.issue or "").split(":")[0]: r.length for r in rows if r.rel_path is None} == {"skipped_non_images": 3, "input_read_failed": None}


def test_folder_scan_and_links(spark, tmp_path):
    root = tmp_path / "book"
    (root / "c1").mkdir(parents=True)
    (root / "c1/p1.png").write_bytes(PIXELS)
    (root / "c1/readme.txt").write_text("x")
    (tmp_path / "out.png").write_bytes(PIXELS)
    os.symlink(root / "c1/p1.png", root / "in.png")
    os.symlink(tmp_path / "out.png", root / "far.png")
    os.symlink(root / "none.png", root / "gone.png")
    assert entries.linked_files(str(root)) == (["in.png", "c1/p1.png"], [("far.png", "outside_input"), ("gone.png", "unresolved")])
    assert "c1/p1.png" in {r.rel_path for r in entries.folder_entries(spark, str(root)).select("rel_path").collect()}


def test_comic_info():
    xml = "<ComicInfo><Series> A </Series><Title> </Title><Number>3</Number><Writer>B, A, B</Writer><Pages><Page Image='2' Bookmark='x'/><Page Image='q' Bookmark='y'/><Page Image='3'/></Pages></ComicInfo>"
    for data in (xml.encode(), b"\xff\xfe" + xml.encode("utf-16-le") + b"x", b"\xfe\xff" + xml.encode("utf-16-be")):
        got = entries.comic_info(entries.text_of(data))
        assert (got["series"], got["title"], got["number"], got["writers"], got["bookmarks"]) == ("A", None, "3", ["A", "B"], [(2, "x")])
    with pytest.raises(ValueError):
        entries.comic_info("<a>")


@pytest.fixture(scope="module")
def book():
    page = lambda c, **k: books.Page(c, "png", PIXELS, **k)
    return [page("v1/one"), page("v1/one", role="split_first"), page("v1/one", role="split_second", continues=True), page("v1/two"), page("v2/one & more")]


def test_cbz(book):
    names = zipfile.ZipFile(io.BytesIO(books.cbz(book, books.BookInfo(cover=b"c", comic_info=b"<x/>")))).namelist()
    assert names == ["##cover.jpg", "ComicInfo.xml", "v1/one/p0001.png", "v1/one/p0002.png", "v1/one/p0003.png", "v1/two/p0001.png", "v2/one & more/p0001.png"]


@pytest.mark.parametrize("nested", [False, True])
def test_epub(book, nested):
    data = books.epub(book, books.BookInfo(title="A <b>", nested=nested, right_to_left=True, series="S", position="1.2"))
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.namelist()[0] == "mimetype" and all(i.compress_type == 0 for i in z.infolist())
    for name in z.namelist():
        if name.endswith((".xml", ".opf", ".ncx", ".xhtml")):
            ET.fromstring(z.read(name))
    opf = z.read("OEBPS/content.opf").decode()
    for item in ET.fromstring(opf).iter("{http://www.idpf.org/2007/opf}item"):
        assert "OEBPS/" + item.get("href") in z.namelist()
    assert 'page-progression-direction="rtl"' in opf and "group-position" in opf
    nav = z.read("OEBPS/nav.xhtml").decode()
    assert ("v1</a><ol>" in nav) == nested and "one &amp; more" in nav


def test_epub_bookmarks_name_source_pages(book):
    toc = books.contents(book, books.BookInfo(bookmarks=[(0, "a"), (2, "b"), (9, "none")]))
    assert toc == [(0, "a", 0), (0, "b", 3)]


def test_sides_by_two_passes():
    rng = random.Random(1)
    for _ in range(500):
        roles = [rng.choice(["normal", "normal", "split_first", "split_second", "rotated"]) for _ in range(rng.randrange(9))]
        rtl, second = rng.random() < 0.5, rng.random() < 0.5
        pair = ("right", "left") if rtl else ("left", "right")
        other = {"left": "right", "right": "left"}
        side, want = pair[second], []
        for r in roles:
            want.append({"normal": side, "split_first": pair[0], "split_second": pair[1], "rotated": "center"}[r])
            side = other[side] if r == "normal" else pair[0]
        seen = False
        for i in range(len(roles) - 1, -1, -1):
            if roles[i] != "normal":
                seen, side = True, pair[1]
            elif seen:
                want[i], side = side, other[side]
        assert books.sides(roles, rtl, second, False) == want


def test_pdf(book):
    data = books.pdf([*book, books.Page("v2/x", "jpg", images.jpeg(np.zeros((16, 16), np.uint8), 80))], books.BookInfo(title="T", nested=True))
    assert data.startswith(b"%PDF-1.7") and data.count(b"/Type/Page/") == 6 and b"DCTDecode" in data and b"/Count -2" in data
    at = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert data[at:].startswith(b"xref")
    for line in data[at:].split(b"\n")[3:6]:
        assert data[int(line[:10]) :].split(b" ", 1)[1].startswith(b"0 obj")


def test_closest_profile():
    assert profiles.closest("kv") == "KV" and profiles.closest("K12") == "K1" and profiles.closest("something else") is None


def test_webtoon_to_book(spark):
    strip = np.full((2400, 400, 3), 255, np.uint8)
    for top in (50, 1250):
        strip[top : top + 900, 40:360] = np.random.default_rng(top).integers(0, 255, (900, 320, 1))
    df = spark.createDataFrame([("b", "c", i, i == 0, bytearray(images.png(strip[i * 1200 : (i + 1) * 1200]))) for i in range(2)], "book_id string, chapter_path string, page_ord long, is_first boolean, content binary")
    options = operator.PageOptions(profile="KV", format="epub", webtoon=True, white_borders=True)
    made = operator.page_outputs(operator.webtoon_pages(df, *options.target), options)
    book = books.build_books(made, "epub", books.BookInfo(title="W")).first()
    assert book.error is None and book.pages == 4  # two slices of each panel


def test_sides_against_the_nearest_spread():
    """Every page by the spread after it, else by the one before, else by its place."""
    rng = np.random.default_rng(2)
    kinds = ["normal", "rotated", "split_first", "split_second"]
    for _ in range(300):
        roles = [kinds[int(k)] for k in rng.choice(4, int(rng.integers(0, 12)), p=[0.7, 0.1, 0.1, 0.1])]
        rtl, second = bool(rng.integers(2)), bool(rng.integers(2))
        pair = ("right", "left") if rtl else ("left", "right")
        spreads = [i for i, r in enumerate(roles) if r != "normal"]
        want = []
        for i, r in enumerate(roles):
            after, before = [s for s in spreads if s > i], [s for s in spreads if s < i]
            n = after[0] - i if after else i - before[-1] - 1 if before else i + second
            want.append(pair[n % 2] if r == "normal" else {"split_first": pair[0], "split_second": pair[1]}.get(r, "center"))
        assert books.sides(roles, rtl, second, False) == want


def test_packages_of_kindle_and_inverted_books():
    page = books.Page("c", "png", images.png(np.full((20, 10), 9, np.uint8)))
    info = books.BookInfo(kindle=True, size=(800, 600), right_to_left=True, invert=True, modified="2026-01-02T03:04:05Z")
    with zipfile.ZipFile(io.BytesIO(books.epub([page], info))) as z:
        opf, xhtml = z.read("OEBPS/content.opf").decode(), z.read("OEBPS/Text/c0001/p0001.xhtml").decode()
    assert 'page-progression-direction="ltr"' in opf and 'name="primary-writing-mode" content="horizontal-lr"' in opf
    assert 'name="region-mag" content="true"' in opf and 'name="cover" content="img1"' in opf and "2026-01-02T03:04:05Z" in opf
    assert 'content="width=10, height=20"' in xhtml and "<style" in xhtml
    small = books.archive([("a", b"x" * 10_000)], deflate=True)
    assert len(small) < 1000 and zipfile.ZipFile(io.BytesIO(small)).read("a") == b"x" * 10_000


def test_components_of_jpeg_files():
    """Fill bytes and markers without a length are passed over; what does not begin as a JPEG or has begun its scan has none."""
    for channels, shape in ((1, (20, 30)), (3, (20, 30, 3))):
        data = images.jpeg(np.zeros(shape, np.uint8), 80)
        assert books._jpeg_components(data) == channels
        assert books._jpeg_components(data[:2] + b"\xff\xff\xff\x01\xff\xd0\xff\xff" + data[3:]) == channels
        assert books._jpeg_components(b"\x00\x00" + data[2:]) is None
        scan = data.index(b"\xff\xda")
        frame = next(i for i in range(len(data)) if data[i] == 0xFF and data[i + 1] in (0xC0, 0xC2))
        length = int.from_bytes(data[frame + 2 : frame + 4], "big") + 2
        assert books._jpeg_components(data[:frame] + data[frame + length : scan] + data[scan:] + data[frame : frame + length]) is None
        assert all(books._jpeg_components(data[:n]) in (None, channels) for n in range(0, 700, 7))
