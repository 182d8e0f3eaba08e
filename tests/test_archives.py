"""Books as a data source: every member once, by ranges, from archives and folders of any kind."""

import io
import os
import struct
import zipfile

import numpy as np
import pytest

from folioloom import api
from folioloom.operators.pages import PageOptions
from folioloom.sinks import images
from folioloom.sources import archives


def _png(level, size=(60, 90)):
    return images.png(np.full(size[::-1], level, np.uint8))


def _zip(path, members, mode="w"):
    with zipfile.ZipFile(path, mode) as z:
        for name, data in members:
            z.writestr(name, data)


def _rows(reader):
    return [tuple(c[i].as_py() for c in b.columns) for p in reader.partitions() for b in reader.read(p) for i in range(b.num_rows)]


def test_mixed_folders_and_names_of_any_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.cbz", "b.Cbz", "plain", "sub/c.ZIP"):
        _zip(tmp_path / name, [("p1.png", _png(1)), ("notes.txt", b"x")])
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "readme").write_bytes(b"text without an ending")
    for i in range(3):
        (tmp_path / f"loose{i}.png").write_bytes(_png(10 + i))
    (tmp_path / "Covers").mkdir()
    (tmp_path / "Covers" / "a.png").write_bytes(_png(9))
    rows = api.scan(spark, str(tmp_path)).collect()
    pages = sorted((os.path.relpath(r.book_id.removeprefix("file:"), tmp_path) if "/" in r.book_id else r.book_id, r.rel_path) for r in rows if r.content is not None)
    assert pages == sorted([(n, "p1.png") for n in ("a.cbz", "b.Cbz", "plain", "sub/c.ZIP")] + [(tmp_path.name, f"loose{i}.png") for i in range(3)])
    issues = {(os.path.basename(r.book_id), (r.issue or "").split(":")[0]) for r in rows if r.issue}
    assert issues == {(n, "skipped_non_images") for n in ("a.cbz", "b.Cbz", "plain", "c.ZIP", tmp_path.name)} | {("broken.zip", "input_read_failed")}
    assert sum(r.is_first for r in rows) == 5 and all((r.width, r.height) == (60, 90) for r in rows if r.content is not None)
    _zip(tmp_path / "book.bin", [("p.png", _png(3))])
    assert [r.rel_path for r in api.scan(spark, str(tmp_path / "book.bin")).collect()] == ["p.png"]
    assert [r.issue.split(":")[0] for r in api.scan(spark, str(tmp_path / "readme")).collect()] == ["input_read_failed"]
    (tmp_path / "none").mkdir()
    assert [r.issue for r in api.scan(spark, str(tmp_path / "none")).collect()] == ["input_empty"]


@pytest.mark.parametrize("wrapped", [False, True])
def test_ranges_hold_every_member_once(tmp_path, monkeypatch, wrapped):
    rng = np.random.default_rng(1)
    top = "top/" * wrapped
    _zip(tmp_path / "big.cbz", [(f"{top}c{i % 3}/p{i}.png" if i else f"{top}p0.png", rng.bytes(int(rng.integers(0, 3000)))) for i in range(120)] + [(f"{top}ComicInfo.xml", b"<ComicInfo/>")])
    for i in range(5):
        _zip(tmp_path / f"small{i}.cbz", [("x.png", b"1"), ("y.png", b"2")])
    whole = sorted(_rows(archives.Reader({"path": str(tmp_path)})), key=str)
    monkeypatch.setattr(archives, "LEAST", 500)
    reader = archives.Reader({"path": str(tmp_path), "slices": "40"})
    shares = reader.partitions()
    assert len(shares) > 30 and any(len(s.pieces) > 1 for s in shares) and all(len(s.pieces) == 1 or sum(os.path.getsize(p.path.removeprefix("file:")) for p in s.pieces) < 10_000 for s in shares)
    assert sorted(_rows(reader), key=str) == whole and len(whole) == 131
    assert sum(r[4] for r in whole) == 6


def test_forged_sizes_and_payloads_that_are_not_read(tmp_path):
    path = tmp_path / "forged.cbz"
    _zip(path, [("p1.png", b"tiny"), ("p2.png", _png(5)), ("notes.txt", b"never read")])
    data = bytearray(path.read_bytes())
    at = data.rindex(b"PK\x01\x02", 0, data.index(b"p2.png", data.index(b"PK\x01\x02")))
    first = data.index(b"PK\x01\x02")
    struct.pack_into("<I", data, first + 24, 0xFFFFFFF0)  # the size that the directory declares
    body = data.index(b"never read")
    data[body : body + 5] = b"XXXXX"  # its checksum is wrong now
    path.write_bytes(data)
    rows = {r[1]: r for r in _rows(archives.Reader({"path": str(path)}))}
    assert at > first and rows["p1.png"][-1] == "too_large" and rows["p1.png"][7] is None
    assert rows["p2.png"][4] and rows["p2.png"][-1] is None and rows[None][-1] == "skipped_non_images" and rows[None][3] == 1


def test_archive_over_two_gibibytes(spark, tmp_path):
    path = tmp_path / "huge.cbz"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 12345)  # a hole before the archive, as of a file that unpacks itself
    _zip(path, [(f"p{i}.png", _png(i)) for i in range(4)], "a")
    assert path.stat().st_size > 2 << 30
    rows = sorted(api.scan(spark, str(path)).collect(), key=lambda r: r.ord)
    assert [(r.rel_path, r.ord, r.is_first) for r in rows] == [(f"p{i}.png", i, i == 0) for i in range(4)] and rows[2].content == _png(2)


def test_members_are_inflated_once(spark, tmp_path):
    """Once issues are known, books, covers, metadata and sizes come from what was read: the archives may be gone."""
    for book in ("one", "two"):
        _zip(tmp_path / f"{book}.cbz", [(f"p{i}.png", _png(40 * i)) for i in range(4)] + [("ComicInfo.xml", b"<ComicInfo><Series>T</Series></ComicInfo>"), ("zbad.png", b"\x89PNG\r\n\x1a\n?")])
    result = api.convert(spark, str(tmp_path), api.Request(options=PageOptions(profile="KoC", format="epub", cropping="disabled")))
    plan = result.issues._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan.split("InMemoryRelation")[0]
    assert result.scanned.count() == 12
    for book in ("one", "two"):
        os.unlink(tmp_path / f"{book}.cbz")
    assert {r.code for r in result.issues.collect()} == {"page_processing_failed", "images_smaller_than_device"}
    made = result.books.collect()
    assert [r.pages for r in made] == [4, 4]
    with zipfile.ZipFile(io.BytesIO(made[0].content)) as z:
        assert "OEBPS/Images/cover.jpg" in z.namelist()
    result.release()


def test_sizes_without_contents(spark, tmp_path):
    _zip(tmp_path / "a.cbz", [("p1.png", _png(1, (30, 20))), ("p2.png", b"no image"), ("ComicInfo.xml", b"<ComicInfo/>")])
    rows = {r.rel_path: r for r in api.scan(spark, str(tmp_path), content=False).collect()}
    assert (rows["p1.png"].width, rows["p1.png"].height, rows["p1.png"].content, rows["p2.png"].width) == (30, 20, None, None) and bytes(rows["ComicInfo.xml"].content) == b"<ComicInfo/>"


def test_a_bad_chapter_of_strips_is_an_issue(spark, tmp_path):
    strip = np.full((900, 400), 255, np.uint8)
    for y in (50, 500):
        strip[y : y + 300, 30:370] = np.random.default_rng(y).integers(0, 200, (300, 340))
    good = [(f"c1/p{i}.png", images.png(strip)) for i in range(3)]
    _zip(tmp_path / "good.cbz", good)
    _zip(tmp_path / "bad.cbz", [*good, ("c2/p.png", b"\x89PNG\r\n\x1a\n?"), ("c3/narrow.png", _png(7, (250, 90)))])
    result = api.convert(spark, str(tmp_path), api.Request(options=PageOptions(profile="KV", format="cbz", webtoon=True)))
    found = sorted((os.path.basename(r.book_id), r.code, r.diagnostic.split(":")[1].strip()) for r in result.issues.where("code = 'webtoon_split_failed'").collect())
    assert found == [("bad.cbz", "webtoon_split_failed", "c2"), ("bad.cbz", "webtoon_split_failed", "c3")]
    made = {os.path.basename(r.book_id): r for r in result.books.collect()}
    assert {b: r.error for b, r in made.items()} == {"good.cbz": None, "bad.cbz": None} and made["good.cbz"].pages == made["bad.cbz"].pages > 0


def test_books_converted_before_are_told(spark, tmp_path):
    _zip(tmp_path / "again.cbz", [("c/p0-kcc.png", _png(1)), ("c/p1-kcc-b.png", _png(2))])
    _zip(tmp_path / "fresh-kcc.cbz", [("c-kcc/p0.png", _png(1)), ("ComicInfo.xml", b"<ComicInfo")])
    result = api.convert(spark, str(tmp_path), api.Request(options=PageOptions(profile="KV", format="cbz", upscale=True)))
    found = sorted((os.path.basename(r.book_id), r.code) for r in result.issues.collect())
    assert found == [("again.cbz", "source_already_converted"), ("fresh-kcc.cbz", "comic_info_unreadable")]
