"""Books from finished pages: CBZ, EPUB 3 and PDF, written page by page to a sink, or as bytes."""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from folioloom.functions.text import NAMESPACE
from folioloom.sources import images as source

NAME = "folioloom"


@dataclass(frozen=True)
class Page:
    chapter: str  # directory of the chapter
    ext: str
    content: bytes
    role: str = "normal"
    black: bool = False
    continues: bool = False


@dataclass
class BookInfo:
    title: str = "book"
    authors: list[str] = field(default_factory=lambda: ["Unknown"])
    language: str = "en-US"
    summary: str | None = None
    series: str | None = None
    position: str | None = None
    right_to_left: bool = False
    spread_shift: bool = False
    one_page: bool = False
    kindle: bool = False
    nested: bool = False
    bookmarks: list[tuple[int, str]] = field(default_factory=list)
    comic_info: bytes | None = None
    cover: bytes | None = None
    size: tuple[int, int] | None = None  # of the screen, for fixed layout
    invert: bool = False  # pages turn against the reading order
    modified: str = "1980-01-01T00:00:00Z"

    @property
    def turns_left(self) -> bool:
        return self.right_to_left != self.invert


# What tells a Kindle that a book is a comic of whole pages, and the style of a page.
KINDLE = {"book-type": "comic", "zero-gutter": "true", "zero-margin": "true", "ke-border-color": "#FFFFFF", "ke-border-width": "0", "orientation-lock": "none", "region-mag": "true"}
STYLE = "html, body { margin: 0; padding: 0; height: 100%; } img { display: inline-block; vertical-align: top; }"


def escape(text: str) -> str:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = text.replace(mark, entity)
    return text


def chapters(pages: list[Page]) -> list[tuple[str, list[Page]]]:
    """Pages by directory, in the order in which directories first appear."""
    found: dict[str, list[Page]] = {}
    for p in pages:
        found.setdefault(p.chapter, []).append(p)
    return list(found.items())


def label(directory: str, title: str) -> str:
    return directory.rsplit("/", 1)[-1] if directory else title


def volume(directory: str) -> str:
    parts = directory.split("/")
    return parts[-2] if len(parts) > 1 else "Untitled"


def archive(entries: list[tuple[str, bytes]], deflate: bool = False) -> bytes:
    """A ZIP in the given order, stored or deflated."""
    out = io.BytesIO()
    z = _Zip(out, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)
    for name, data in entries:
        z.put(name, data)
    z.close()
    return out.getvalue()


class _Tail:
    """The end of a file that is written front to back: what was settled is with the sink, the rest can still be sought in."""

    def __init__(self, sink):
        self.sink, self.base, self.buffer = sink, 0, io.BytesIO()

    def write(self, data) -> int:
        return self.buffer.write(data)

    def tell(self) -> int:
        return self.base + self.buffer.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        self.buffer.seek(at - self.base)
        return at

    def flush(self) -> None:
        pass

    def settle(self) -> None:
        data = self.buffer.getvalue()
        self.sink.write(data)
        self.base, self.buffer = self.base + len(data), io.BytesIO()


class _Zip:
    """A ZIP of any size that holds one member at a time; headers tell sizes, so readers need no directory."""

    def __init__(self, sink, kind: int = zipfile.ZIP_STORED):
        self.tail, self.kind = _Tail(sink), kind
        self.zip = zipfile.ZipFile(self.tail, "w", kind)

    def put(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, self.kind)
        self.tail.settle()

    def close(self) -> int:
        self.zip.close()
        self.tail.settle()
        return self.tail.base


class _Chapters:
    """Places of pages in chapters, which are in the order in which they first appear, though their pages may be mixed."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.numbers: dict[str, int] = {}

    def place(self, chapter: str) -> tuple[int, int]:
        """Number of the chapter and of the page in it, from 1."""
        k = self.numbers.setdefault(chapter, len(self.numbers) + 1)
        self.counts[chapter] = self.counts.get(chapter, 0) + 1
        return k, self.counts[chapter]


class Cbz:
    """A CBZ written to a sink page by page."""

    def __init__(self, sink, info: BookInfo):
        self.zip, self.info, self.places = _Zip(sink), info, _Chapters()
        self.folders: dict[str, str] = {}
        self.seen: dict[str, int] = {}
        if info.cover:
            self.zip.put("##cover.jpg", info.cover)
        if info.comic_info:
            self.zip.put("ComicInfo.xml", info.comic_info)

    def _folder(self, directory: str) -> str:
        parts = [p.replace("\\", "-") for p in directory.split("/") if p not in ("", ".", "..")]
        folder = "/".join(parts) or re.sub(r"[/\\]", "-", self.info.title)
        self.seen[folder] = self.seen.get(folder, 0) + 1
        return folder + (f" ({self.seen[folder]})" if self.seen[folder] > 1 else "")

    def add(self, p: Page) -> None:
        if p.chapter not in self.folders:
            self.folders[p.chapter] = self._folder(p.chapter)
        self.zip.put(f"{self.folders[p.chapter]}/p{self.places.place(p.chapter)[1]:04d}.{p.ext}", p.content)

    def finish(self) -> int:
        if not self.folders:
            raise ValueError("a book needs a page")
        return self.zip.close()


def _whole(kind: type, pages: list[Page], info: BookInfo) -> bytes:
    out = io.BytesIO()
    book = kind(out, info)
    for p in pages:
        book.add(p)
    book.finish()
    return out.getvalue()


def cbz(pages: list[Page], info: BookInfo) -> bytes:
    return _whole(Cbz, pages, info)


def sides(roles: list[str], right_to_left: bool, on_second: bool, one_page: bool) -> list[str]:
    """Side of each page, by the parity of its distance from a spread."""
    if one_page:
        return ["center"] * len(roles)
    pair = ("right", "left") if right_to_left else ("left", "right")
    flips, spread = [i + on_second for i in range(len(roles))], None
    for i, role in enumerate(roles):  # from the spread before
        spread = i if role != "normal" else spread
        flips[i] = flips[i] if spread is None else i - spread - 1
    spread = None
    for i in range(len(roles) - 1, -1, -1):  # the spread after counts first
        spread = i if roles[i] != "normal" else spread
        flips[i] = flips[i] if spread is None else spread - i
    split = {"normal": None, "split_first": pair[0], "split_second": pair[1]}
    return [split.get(role, "center") or pair[n % 2] for role, n in zip(roles, flips, strict=True)]


def identifier(info: BookInfo, titles: list[str]) -> str:
    seed = "\0".join([info.title, ", ".join(info.authors), *titles])
    return str(uuid.uuid5(uuid.UUID(NAMESPACE), seed))


MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def contents(pages: list[Page], info: BookInfo) -> list[tuple[int, str, int]]:
    """(level, label, page index) of the table of contents: bookmarks if there are any, else chapters, under volumes if nested."""
    if info.bookmarks:
        starts = [i for i, p in enumerate(pages) if not p.continues]
        return [(0, name, starts[n]) for n, name in info.bookmarks if n < len(starts)]
    at, found = 0, []
    for directory, own in chapters(pages):
        found.append((directory, at))
        at += len(own)
    if not info.nested:
        return [(0, label(d, info.title), i) for d, i in found]
    volumes: dict[str, list[tuple[str, int]]] = {}
    for d, i in found:
        volumes.setdefault(volume(d), []).append((d, i))
    return [x for v, own in volumes.items() for x in [(0, v, own[0][1]), *((1, label(d, info.title), i) for d, i in own)]]


def _list(toc: list[tuple[int, str, int]], href) -> str:
    out = []
    for k, (level, name, i) in enumerate(toc):
        deeper = k + 1 < len(toc) and toc[k + 1][0] > level
        out.append(f'<li><a href="{href(i)}">{escape(name)}</a>' + ("<ol>" if deeper else "</li>"))
        if not deeper and level and (k + 1 == len(toc) or toc[k + 1][0] < level):
            out.append("</ol></li>")
    return "".join(out)


# Where readers find a book's package.
CONTAINER = b'<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


class Epub:
    """An EPUB 3 written to a sink page by page; what tells of all pages comes last."""

    def __init__(self, sink, info: BookInfo):
        self.zip, self.info, self.places = _Zip(sink), info, _Chapters()
        self.pages: list[tuple[Page, str]] = []  # without contents
        self.zip.put("mimetype", b"application/epub+zip")
        self.zip.put("META-INF/container.xml", CONTAINER)
        if info.cover:
            self.zip.put("OEBPS/Images/cover.jpg", info.cover)

    def add(self, p: Page) -> None:
        if p.ext not in MEDIA:
            raise ValueError(f"no media type for {p.ext}")
        k, j = self.places.place(p.chapter)
        name = f"c{k:04d}/p{j:04d}"
        w, h = source.dimensions(p.content) or (0, 0)
        body = ' style="background-color:#000000;"' if p.black else ""
        hidden = '<div style="display:none;">.</div>' if self.info.kindle else ""
        known = w > 0 and h > 0
        view = f'<meta name="viewport" content="width={w}, height={h}"/>' if known else ""
        size = f'width="{w}" height="{h}" ' if known else ""
        xhtml = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(name)}</title><meta charset="utf-8"/>{view}<style type="text/css">{STYLE}</style></head><body{body}><div style="text-align:center;">{hidden}<img {size}src="../../Images/{name}.{p.ext}" alt=""/></div></body></html>'
        self.zip.put(f"OEBPS/Images/{name}.{p.ext}", p.content)
        self.zip.put(f"OEBPS/Text/{name}.xhtml", xhtml.encode())
        self.pages.append((replace(p, content=b""), name))

    def finish(self) -> int:
        if not self.pages:
            raise ValueError("a book needs a page")
        of_chapter: dict[str, list[tuple[Page, str]]] = {}
        for p, name in self.pages:
            of_chapter.setdefault(p.chapter, []).append((p, name))
        ordered = [x for own in of_chapter.values() for x in own]
        for name, data in packaged([p for p, _ in ordered], [name for _, name in ordered], self.info).items():
            self.zip.put(f"OEBPS/{name}", data.encode())
        return self.zip.close()


def epub(pages: list[Page], info: BookInfo) -> bytes:
    return _whole(Epub, pages, info)


def packaged(pages: list[Page], names: list[str], info: BookInfo) -> dict[str, str]:
    """Package, table of contents in the older form, and navigation of pages in reading order, whose contents aren't needed."""
    book = identifier(info, [label(d, info.title) for d, _ in chapters(pages)])
    toc = contents(pages, info)
    manifest, spine = ['<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'], []
    if info.cover:
        manifest.append('<item id="cover" href="Images/cover.jpg" media-type="image/jpeg" properties="cover-image"/>')
    side_of = sides([p.role for p in pages], info.right_to_left, info.invert != info.spread_shift, info.one_page)
    for i, (p, name, side) in enumerate(zip(pages, names, side_of, strict=True), 1):
        cover = ' properties="cover-image"' if i == 1 and not info.cover else ""
        manifest += [f'<item id="img{i}" href="Images/{name}.{p.ext}" media-type="{MEDIA[p.ext]}"{cover}/>', f'<item id="page{i}" href="Text/{name}.xhtml" media-type="application/xhtml+xml"/>']
        prefix = "rendition:" if side == "center" or not info.kindle else ""
        linear = ' linear="yes"' if info.kindle else ""
        spine.append(f'<itemref idref="page{i}"{linear} properties="{prefix}page-spread-{side}"/>')
    meta = [f'<dc:identifier id="BookID">urn:uuid:{book}</dc:identifier>', f"<dc:title>{escape(info.title)}</dc:title>", f"<dc:language>{escape(info.language)}</dc:language>", *(f"<dc:creator>{escape(a)}</dc:creator>" for a in info.authors)]
    meta += [f"<dc:description>{escape(info.summary)}</dc:description>"] if info.summary else []
    meta.append(f'<dc:contributor id="contributor">{NAME}</dc:contributor><meta property="dcterms:modified">{escape(info.modified)}</meta><meta name="cover" content="{"cover" if info.cover else "img1"}"/><meta property="rendition:layout">pre-paginated</meta><meta property="rendition:spread">landscape</meta>')
    if info.series and not info.kindle:
        meta.append(f'<meta property="belongs-to-collection" id="series">{escape(info.series)}</meta><meta refines="#series" property="collection-type">series</meta>')
        meta += [f'<meta refines="#series" property="group-position">{escape(info.position)}</meta>'] if info.position else []
    if info.kindle and info.size:
        told = {"fixed-layout": "true", "original-resolution": f"{info.size[0]}x{info.size[1]}", **KINDLE, "primary-writing-mode": "horizontal-rl" if info.turns_left else "horizontal-lr"}
        meta += [f'<meta name="{k}" content="{v}"/>' for k, v in told.items()]
    progression = "rtl" if info.turns_left else "ltr"
    opf = f'<?xml version="1.0" encoding="UTF-8"?>\n<package version="3.0" unique-identifier="BookID" xml:lang="{escape(info.language)}" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{"".join(meta)}</metadata><manifest>{"".join(manifest)}</manifest><spine page-progression-direction="{progression}" toc="ncx">{"".join(spine)}</spine></package>'
    href = lambda i: f"Text/{names[i]}.xhtml"
    order: dict[int, int] = {}
    points = []
    for k, (level, name, i) in enumerate(toc):
        n = order.setdefault(i, len(order) + 1)
        points.append(f'<navPoint id="n{k + 1}" playOrder="{n}"><navLabel><text>{escape(name)}</text></navLabel><content src="{href(i)}"/>')
        follows = toc[k + 1][0] if k + 1 < len(toc) else 0
        points.append("</navPoint>" * (level - follows + 1))
    marks = "".join(f'<li><a href="{href(i)}">{i + 1}</a></li>' for i in range(len(pages)))
    ncx = f'<?xml version="1.0" encoding="UTF-8"?>\n<ncx version="2005-1" xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content="urn:uuid:{book}"/></head><docTitle><text>{escape(info.title)}</text></docTitle><navMap>{"".join(points)}</navMap></ncx>'
    nav = f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(info.title)}</title></head><body><nav epub:type="toc"><ol>{_list(toc, href)}</ol></nav><nav epub:type="page-list"><ol>{marks}</ol></nav></body></html>'
    return {"content.opf": opf, "toc.ncx": ncx, "nav.xhtml": nav}


def _text(s: str) -> str:
    return "<FEFF" + s.encode("utf-16-be").hex().upper() + ">"


class Pdf:
    """A PDF written to a sink page by page: one image a page; JPEGs are embedded as they are, others as deflated samples.

    Catalogue, page tree and outlines come last. Places have ten digits, so a PDF of more than 10^10 bytes is an error.
    """

    def __init__(self, sink, info: BookInfo):
        self.sink, self.info, self.size, self.digest = sink, info, 0, hashlib.md5()
        self.places = [0, 0]  # of objects; the catalogue and the page tree are the first two
        self.pages: list[tuple[Page, int]] = []  # without contents
        self._out(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")

    def _out(self, data: bytes) -> None:
        self.sink.write(data)
        self.digest.update(data)
        self.size += len(data)

    def _put(self, body: bytes, number: int | None = None) -> int:
        if number is None:
            self.places.append(0)
            number = len(self.places)
        if self.size >= 10**10:
            raise ValueError("a PDF can't be longer than 10^10 bytes")
        self.places[number - 1] = self.size
        self._out(f"{number} 0 obj\n".encode() + body + b"\nendobj\n")
        return number

    def add(self, p: Page) -> None:
        stream = lambda d, b: f"<<{d}/Length {len(b)}>>\nstream\n".encode() + b + b"\nendstream"
        if p.ext in ("jpg", "jpeg") and (n := _jpeg_components(p.content)) in (1, 3):
            w, h = source.dimensions(p.content)
            image = self._put(stream(f"/Type/XObject/Subtype/Image/Width {w}/Height {h}/ColorSpace/{'DeviceGray' if n == 1 else 'DeviceRGB'}/BitsPerComponent 8/Filter/DCTDecode", p.content))
        else:
            a = source.decode(p.content).pixels
            h, w = a.shape[:2]
            image = self._put(stream(f"/Type/XObject/Subtype/Image/Width {w}/Height {h}/ColorSpace/{'DeviceGray' if a.ndim == 2 else 'DeviceRGB'}/BitsPerComponent 8/Filter/FlateDecode", zlib.compress(a.tobytes(), 9)))
        draw = self._put(stream("/Filter/FlateDecode", zlib.compress(f"q {w} 0 0 {h} 0 0 cm /Im Do Q".encode())))
        page = self._put(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {w} {h}]/Resources<</XObject<</Im {image} 0 R>>>>/Contents {draw} 0 R>>".encode())
        self.pages.append((replace(p, content=b""), page))

    def _outlines(self, pages: list[Page], kids: list[int]) -> int:
        toc = contents(pages, BookInfo(title=self.info.title, nested=self.info.nested))
        root = len(self.places) + 1
        numbers = [root + 1 + i for i in range(len(toc))]
        parent, brothers, last = [], {}, None
        for i, (level, _, _) in enumerate(toc):
            last = i if level == 0 else last
            parent.append(None if level == 0 else last)
            brothers.setdefault(parent[i], []).append(i)
        tops = brothers[None]
        self._put(f"<</Type/Outlines/First {numbers[tops[0]]} 0 R/Last {numbers[tops[-1]]} 0 R/Count {len(tops)}>>".encode())
        at = {i: n for row in brothers.values() for n, i in enumerate(row)}
        for i, (_, name, page) in enumerate(toc):
            row, own, n = brothers[parent[i]], brothers.get(i), at[i]
            links = f"/Prev {numbers[row[n - 1]]} 0 R" if n else ""
            links += f"/Next {numbers[row[n + 1]]} 0 R" if n + 1 < len(row) else ""
            links += f"/First {numbers[own[0]]} 0 R/Last {numbers[own[-1]]} 0 R/Count -{len(own)}" if own else ""
            self._put(f"<</Title {_text(name)}/Parent {root if parent[i] is None else numbers[parent[i]]} 0 R/Dest[{kids[page]} 0 R/Fit]{links}>>".encode())
        return root

    def finish(self) -> int:
        if not self.pages:
            raise ValueError("a book needs a page")
        of_chapter: dict[str, list[tuple[Page, int]]] = {}
        for p, number in self.pages:
            of_chapter.setdefault(p.chapter, []).append((p, number))
        ordered = [x for own in of_chapter.values() for x in own]
        kids, info = [number for _, number in ordered], self.info
        root = self._outlines([p for p, _ in ordered], kids)
        about = self._put(f"<</Title {_text(info.title)}/Author {_text(', '.join(info.authors))}/Producer {_text(NAME)}>>".encode())
        direction = "/ViewerPreferences<</Direction/R2L>>" if info.right_to_left else ""
        self._put(f"<</Type/Catalog/Pages 2 0 R/Outlines {root} 0 R/PageMode/UseOutlines{direction}>>".encode(), 1)
        self._put(f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>".encode(), 2)
        start = self.size
        self._out(f"xref\n0 {len(self.places) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in self.places))
        name = self.digest.hexdigest()
        self._out(f"trailer\n<</Size {len(self.places) + 1}/Root 1 0 R/Info {about} 0 R/ID[<{name}><{name}>]>>\nstartxref\n{start}\n%%EOF\n".encode())
        return self.size


def pdf(pages: list[Page], info: BookInfo) -> bytes:
    return _whole(Pdf, pages, info)


def _jpeg_components(data: bytes) -> int | None:
    """Number of components of an 8-bit Huffman-coded JPEG, else null: markers are read up to the first scan, and bytes that only fill are passed over."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
        elif mark in (0xC0, 0xC1, 0xC2):
            return data[at + 9] if at + 9 < len(data) and data[at + 4] == 8 else None
        elif mark in (0xD8, 0xD9, 0xDA) or 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return None
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


BUILDERS = {"cbz": cbz, "epub": epub, "pdf": pdf}
WRITERS = {"cbz": Cbz, "epub": Epub, "pdf": Pdf}
BOOKS = "book_id string, format string, bytes long, pages int, chapters int, content binary, error string"


def build_books(outputs: DataFrame, fmt: str, info: BookInfo) -> DataFrame:
    """One row a book of finished pages (book_id, chapter_path, page_ord, piece_ord, role, ext, black_background, content).

    The only shuffle is by book; a book is one group, bounded by what a reader can hold.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group[group["error"].isna()].sort_values(["page_ord", "piece_ord"])
        pages = [Page(r.chapter_path, r.ext, bytes(r.content), r.role, bool(r.black_background), r.piece_ord > 0) for r in rows.itertuples()]
        try:
            data, error = BUILDERS[fmt](pages, info), None
        except ValueError as e:
            data, error = None, f"book_build_failed: {e}"
        return pd.DataFrame({"book_id": [key[0]], "format": fmt, "bytes": len(data or b""), "pages": len(pages), "chapters": len(chapters(pages)), "content": [data], "error": [error]})

    return outputs.groupBy("book_id").applyInPandas(run, BOOKS)


def alternate(path: str, n: int) -> str:
    """The n-th name for a file whose name is taken: ` (folioloom)`, ` (folioloom 2)`, and so on; `.kepub.epub` stays whole."""
    stem, ext = (path[: -len(".kepub.epub")], ".kepub.epub") if path.endswith(".kepub.epub") else os.path.splitext(path)
    return path if n == 0 else f"{stem} ({NAME}{'' if n == 1 else f' {n}'}){ext}"
