"""Whole conversions."""

import io
import os
import zipfile

import numpy as np
import pytest

from folioloom import api
from folioloom.operators.pages import PageOptions
from folioloom.sinks import images


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    root = tmp_path_factory.mktemp("shelf")
    for book in ("one", "two"):
        with zipfile.ZipFile(root / f"{book}.cbz", "w") as z:
            for i in range(4):
                page = np.full((150, 100), 255, np.uint8)
                page[20:130, 15:85] = 40 + 12 * i
                z.writestr(f"c{i // 2 + 1}/p{i}.png", images.png(page))
            z.writestr("c1/zbroken.png", b"\x89PNG\r\n\x1a\nnothing")
            z.writestr("notes.txt", "x")
            z.writestr("ComicInfo.xml", "<ComicInfo><Series>Tale</Series><Number>7</Number><Writer>Z, A</Writer></ComicInfo>")
    return str(root)


@pytest.mark.parametrize("fmt", ["cbz", "epub", "pdf"])
def test_convert_and_publish(spark, shelf, tmp_path, fmt):
    request = api.Request(options=PageOptions(profile="KoC" if fmt == "epub" else "KV", format=fmt))
    result = api.convert(spark, shelf, request)
    events = api.publish(result, str(tmp_path), api.resolve(request))
    assert [e["sequence"] for e in events] == [0, 1, 2] and {e["type"] for e in events[1:]} == {"completed"}
    assert {r.code for r in result.issues.collect()} == {"skipped_non_images", "page_processing_failed", "images_smaller_than_device"}
    names = sorted(os.listdir(tmp_path))
    assert names == [f"{b}.{'kepub.epub' if fmt == 'epub' else fmt}" for b in ("one", "two")]
    if fmt == "epub":
        z = zipfile.ZipFile(tmp_path / names[0])
        opf = z.read("OEBPS/content.opf").decode()
        assert "Tale #007" in opf and "<dc:creator>A</dc:creator><dc:creator>Z</dc:creator>" in opf and "OEBPS/Images/cover.jpg" in z.namelist()
    if fmt == "cbz":
        z = zipfile.ZipFile(io.BytesIO((tmp_path / names[0]).read_bytes()))
        assert [n for n in z.namelist()] == [f"c{c}/p{i:04d}.jpg" for c in (1, 2) for i in (1, 2)]


def test_labelled_spreads(spark, shelf):
    pages = api.page_rows(api.scan(spark, shelf + "/one.cbz")).where("source_path NOT LIKE '%broken%'")
    joined, skipped = api.join_spreads(pages, (0, 1, 3), True)
    rows = joined.orderBy("page_ord").collect()
    assert len(rows) == 3 and sorted(tuple(r)[1:] for r in skipped.collect()) == [(1, "part_of_previous_pair"), (3, "no_page_after")]
    from folioloom.sources.images import dimensions

    assert [dimensions(bytes(r.content)) for r in rows] == [(200, 150), (100, 150), (100, 150)]


def test_dry_run_and_errors(spark, shelf):
    rows = {r.output: r for r in api.dry_run(spark, shelf, api.Request()).collect()}
    assert set(rows) == {"one.cbz", "two.cbz"} and rows["one.cbz"].pages == 5 and rows["one.cbz"].warn_small
    with pytest.raises(api.ConversionError, match="did you mean KV"):
        api.resolve(api.Request(options=PageOptions(profile="kv")))
    with pytest.raises(api.ConversionError) as e:
        api.resolve(api.Request(options=PageOptions(profile="OTHER")))
    assert (e.value.code, e.value.stage) == ("invalid_resolution", "configuration")
    assert api.list_profiles(spark).first().code == "K1"


def test_labels_hold_for_each_book_by_itself(spark, tmp_path):
    """A label at the end of a short book is skipped there and joined in a longer one; bookmarks move with the pages joined before them."""
    for book, n in (("short", 2), ("long", 5)):
        with zipfile.ZipFile(tmp_path / f"{book}.cbz", "w") as z:
            for i in range(n):
                z.writestr(f"p{i}.png", images.png(np.full((90, 60), 10 * i, np.uint8)))
            z.writestr("ComicInfo.xml", f"<ComicInfo><Pages><Page Image='{n - 1}' Bookmark='Last'/></Pages></ComicInfo>")
    request = api.Request(options=PageOptions(profile="KoC", format="epub", cropping="disabled"), labels=(1,))
    result = api.convert(spark, str(tmp_path), request)
    assert [(os.path.basename(r.book_id), r.diagnostic) for r in result.issues.where("code = 'spread_labels_skipped'").collect()] == [("short.cbz", "position 1: no_page_after")]
    made = {os.path.basename(r.book_id): r for r in result.books.collect()}
    assert {b: r.error for b, r in made.items()} == {"short.cbz": None, "long.cbz": None}
    with zipfile.ZipFile(io.BytesIO(made["long.cbz"].content)) as z:
        texts = sorted(n for n in z.namelist() if n.endswith(".xhtml") and "Text" in n)
        last = z.read("toc.ncx" if "toc.ncx" in z.namelist() else "OEBPS/toc.ncx").decode()
    assert f'src="{texts[-1].removeprefix("OEBPS/")}"' in last
    assert api.paired((0, 1, 2, 3, 7)) == ([0, 2, 7], [1, 3]) and [api.position_after(p, [0, 2], 4) for p in range(4)] == [0, 0, 1, 1]


def test_publishing_again_finds_its_files(spark, shelf, tmp_path):
    request = api.resolve(api.Request(options=PageOptions(profile="KV", format="cbz")))
    result = api.convert(spark, shelf, request)
    first = {r.path for r in api.written(result, str(tmp_path), request).collect()}
    again = {r.path for r in api.written(result, str(tmp_path), request).collect()}
    assert first == again == {str(tmp_path / n) for n in os.listdir(tmp_path)} and len(first) == 2
    for name in os.listdir(tmp_path):
        (tmp_path / name).write_bytes(b"of another")
    other = {os.path.basename(r.path) for r in api.written(result, str(tmp_path), request).collect()}
    assert other == {"one (folioloom).cbz", "two (folioloom).cbz"}
    events = api.publish(result, str(tmp_path), request)
    told = api.report(events, [{"book_id": "b", "code": "c", "diagnostic": None, "path": "p"}])
    assert told.splitlines()[0] == "b: c at p" and "-> " in told


def test_long_names_fit(spark):
    from pyspark.sql import functions as F

    from folioloom.functions import text

    names = ["é" * 200, "a" * 300, "漢" * 90, "short", "x" * 240 + ". .", "a:b?" * 80]
    df = spark.createDataFrame([(f"/in/{n}.cbz",) for n in names], "book_id string")
    request = api.resolve(api.Request(options=PageOptions(profile="KoC", format="epub")))
    for r in df.select(api.output_name(request).alias("name")).collect():
        assert len(r.name.encode()) + len(" (folioloom 9999)") <= 255 and r.name.endswith(".kepub.epub") and not r.name[: -len(".kepub.epub")].endswith((".", " "))
    cut = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.cut_bytes(F.col("n"), 7).alias("c")).collect()
    assert all(r.c == r.n.encode()[:7].decode(errors="ignore") for r in cut)


def test_folders_with_links_and_large_files(spark, tmp_path, monkeypatch):
    from folioloom.sources import entries

    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "secret.png").write_bytes(b"x")
    book = tmp_path / "book"
    book.mkdir()
    (book / "a.png").write_bytes(b"x" * 10)
    (book / "big.png").write_bytes(b"x" * 1000)
    os.symlink(outside / "secret.png", book / "link.png")
    os.symlink(book / "a.png", book / "own.png")
    os.symlink(outside, book / "folder")
    monkeypatch.setattr(entries, "MAX_BYTES", 100)
    rows = {r.rel_path: r for r in api.scan(spark, str(book)).collect()}
    assert {p: (r.issue or "").split(":")[0] for p, r in rows.items()} == {"a.png": "", "own.png": "", "big.png": "too_large", "link.png": "link_skipped", "folder": "link_skipped"}
    assert rows["big.png"].content is None and rows["link.png"].content is None


def test_whole_archives(spark, shelf):
    from folioloom.sources import entries

    every = [r.rel_path for r in entries.zip_entries(spark, shelf + "/one.cbz", every=True).collect()]
    assert "notes.txt" in every and len(every) == 7


def test_stamps_are_utc_in_any_session(spark):
    from pyspark.sql import functions as F

    from folioloom.functions import text

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert spark.range(1).select(text.utc_stamp(F.lit(86_400))).first()[0] == "1970-01-02T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_covers_and_labels_beside_books(spark, tmp_path):
    """Covers by name, labels by a file like the book plus .json; a list that can't be read is an issue and the book goes on."""
    for book in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{book}.cbz", "w") as z:
            for i in range(4):
                z.writestr(f"p{i}.png", images.png(np.full((90, 60), 10 * i, np.uint8)))
    (tmp_path / "Covers").mkdir()
    (tmp_path / "Covers" / "TWO.png").write_bytes(images.png(np.full((30, 20), 222, np.uint8)))
    (tmp_path / "one.cbz.json").write_text('{"spreads": [0, 3]}')
    (tmp_path / "two.cbz.json").write_text('{"spreads": [-1]}')
    request = api.Request(options=PageOptions(profile="KoC", format="epub", cropping="disabled", splitter="rotate"))
    result = api.convert(spark, str(tmp_path), request)
    found = sorted((os.path.basename(r.book_id or ""), r.code) for r in result.issues.where("code LIKE 'spread%' OR code LIKE 'cover%'").collect())
    assert found == [("one.cbz", "spread_labels_skipped"), ("two.cbz", "spread_labels_read_failed")]
    made = {os.path.basename(r.book_id): r for r in result.books.collect()}
    assert made["two.cbz"].error is None and made["two.cbz"].pages == 4 and made["one.cbz"].pages == 3
    from folioloom.sources import images as source

    with zipfile.ZipFile(io.BytesIO(made["two.cbz"].content)) as z:
        assert source.dimensions(z.read("OEBPS/Images/cover.jpg")) == (20, 30)
    one = api.convert(spark, str(tmp_path), api.Request(options=request.options, cover=str(tmp_path / "Covers" / "TWO.png")))
    for r in one.books.collect():
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            assert source.dimensions(z.read("OEBPS/Images/cover.jpg")) == (20, 30)
