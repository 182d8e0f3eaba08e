"""Main text of web pages: nearest-URL page differencing, confirmed by what pages mark.

A page is cut into lines (blocks). Urls are put in order by host, path and url, and every page is paired with the page
before or after it on its host, whichever path shares the longer prefix with its own (the one before, if equal). The
lines of both are aligned by longest common subsequence: what both have in the same order is the template, and the rest
is the text. Pages of one url share one neighbour, the page of smallest identifier of the neighbouring url. The order is
that of the whole table, so the partitions don't matter. A page whose host has no other url keeps its lines.

Markup then confirms each line. Blocks of menus, headers, footers, asides, forms, notices, adverts and reader comments
are no text though the neighbour lacks them, article elements of readers and advertisers too. That a class or an
identifier has a part such as menu, share or related is taken as such a mark inside an article as well, which is a
choice: running text is seldom named so. Where a page has an article (or else a main) element, lines outside it are no
text either, and inside it a shared line goes unless it is running text: it stands in no paragraph, heading, item, cell
or the like, or is links from end to end. Running text of an article stays, shared or not, since neighbours quote one
another. A neighbour that shares half of an article's running text or more (of all its lines, if it has no running text)
is another version of it and tells nothing about its lines.

Null or empty html gives an empty text. Markup that is cut off at the end is dropped. Null urls are one url of a host of
their own. Repeated rows give one row each, and equal urls are no neighbours. Very long pages are read in linear time
and aligned in bounded memory. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .words import slices

# Element names and name parts of classes, ids and roles.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GONE = frozenset("aside audio button canvas dialog footer form head iframe menu nav noscript object option select svg template textarea title video".split())
RAW = "script|style|textarea|title|noscript|iframe|xmp"
CHROME = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies share sharing sidebar skip social sponsor sponsored subscribe toolbar".split())
#: Of those, names by which an article element is no text of the page's own.
OTHERS = frozenset("ad ads advert advertisement comment comments disqus promo promoted replies sponsor sponsored".split())
#: Elements of running text.
RUNNING = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
ROLES = frozenset("banner complementary contentinfo dialog form menu menubar navigation search".split())

#: Attributes: a quote opens a value only after "="; one that isn't closed is a character.
INSIDE = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{INSIDE}(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({INSIDE})(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Where a line stands; "loose" ones are no running text.
REGIONS = ("page", "chrome", "article", "article loose", "main", "main loose")
#: Bits of an alignment table; pages of one url for each part that they are dealt to.
TABLE, PART = 1 << 28, 512
#: White space of blocks.
SPACE = re.compile(r"\s+")


def _dropped(name: str, attrs: str, inside: bool) -> bool:
    if name in GONE or name == "header" and not inside:
        return True
    for key, value in ATTR.findall(attrs) if attrs.strip() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ROLES or key in ("class", "id") and name not in ("html", "body", "article", "main") and not CHROME.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if key == "class" and name == "article" and not OTHERS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if key in ("class", "id") and not inside and name not in ("html", "body") and "header" in re.split(r"[^a-z0-9]+", value):
            return True
    return False


def lines(page: str) -> list[tuple[str, str]]:
    """The blocks of a page in order: (text, region), a region being one of REGIONS."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and the region inside them
    open_names: Counter[str] = Counter()
    region, buffer, at = "page", [], 0
    depth, running = 0, False  # open elements of running text; whether the block has any

    def add(text: str) -> None:
        nonlocal running
        buffer.append(text)
        running = running or depth > 0 and not open_names["a"] and not text.isspace()

    def leave() -> str:
        nonlocal depth
        name = stack.pop()[0]
        open_names[name] -= 1
        depth -= name in RUNNING
        return name

    def flush() -> None:
        nonlocal running
        if buffer:
            if text := SPACE.sub(" ", entities.unescape("".join(buffer))).strip():
                out.append((text, region if running or region in ("page", "chrome") else f"{region} loose"))
            buffer.clear()
        running = False

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        closing, name, attrs = m[2], (m[3] or "").lower(), m[4] or ""
        if not name:
            continue
        if name == "br":
            buffer.append(" ")
            continue
        new = region
        if closing:
            if open_names[name]:
                while leave() != name:
                    pass
                new = stack[-1][1] if stack else "page"
        elif name not in VOID and not attrs.endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name or name in BLOCK and stack and stack[-1][0] == "p":
                leave()
                new = stack[-1][1] if stack else "page"
            inside = new in ("article", "main")
            if new != "chrome":
                new = "chrome" if _dropped(name, attrs, inside) else name if name == "article" or name == "main" and new == "page" else new
            stack.append((name, new))
            open_names[name] += 1
            depth += name in RUNNING
        if name in BLOCK or new != region:
            flush()
        region = new
    if at < len(page) and not re.match(r"<[a-zA-Z/!?]", page[at:]):
        add(page[at:])
    flush()
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Rows of the table of common subsequences as bit vectors: a zero bit j says that the length grows at column j."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    yield v
    for x in a:
        hit = v & where.get(x, 0)
        v = (v + hit | v - hit) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of each prefix of b the length of its longest common subsequence with a."""
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def shared(a: list[int], b: list[int]) -> set[int]:
    """Indices of `a` in a longest common subsequence with `b`, in memory of about TABLE bits; larger tables are halved."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.add(i0)
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.add(i1)
        x, y = a[i0:i1], b[j0:j1]
        if not x or not y:
            continue
        if len(x) > 1 and len(x) * len(y) > TABLE:
            half = len(x) // 2
            best = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            todo += [(i0, i0 + half, j0, j0 + best), (i0 + half, i1, j0 + best, j1)]
            continue
        rows = list(_rows(x, y))
        length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
        i, j = len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                found.add(i0 + i)
            elif length(i - 1, j) == length(i, j):
                i -= 1
            else:
                j -= 1
    return found


def confirmed(texts: list[str], regions: list[str], common: set[int]) -> str:
    """The text of a page of which the lines in `common` are shared with its neighbour."""
    for kind in ("article", "main"):
        own = [i for i, r in enumerate(regions) if r in (kind, f"{kind} loose")]
        if own:
            # Of another version of the article nothing can be told.
            told = [i for i in own if regions[i] == kind] or own
            version = 2 * sum(len(texts[i]) for i in told if i in common) >= sum(len(texts[i]) for i in told)
            return "\n".join(texts[i] for i in own if version or regions[i] == kind or i not in common)
    return "\n".join(t for i, (t, r) in enumerate(zip(texts, regions, strict=True)) if r == "page" and i not in common)


def text_of(blocks: list[tuple[str, str]], neighbour: list[str] | None) -> str:
    """The text of a page next to the lines of its neighbour, if it has one."""
    common = shared([line_id(t) for t, _ in blocks], [line_id(t) for t in neighbour]) if neighbour else set()
    return confirmed([t for t, _ in blocks], [r for _, r in blocks], common)


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines' identifiers of all pages."""
    for batch in batches:
        for a, z in slices(batch.column("html"), 1 << 22):
            part = batch.slice(a, z - a)
            ids = [[line_id(t) for t, _ in lines(page.as_py() or "")] for page in part.column("html")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "path")), pa.array(ids, pa.list_(pa.int64()))], ["page_id", "url", "host", "path", "ids"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of all pages, and where they stand (places in REGIONS)."""
    code = {r: i for i, r in enumerate(REGIONS)}
    for batch in batches:
        for a, z in slices(batch.column("html"), 1 << 22):
            part = batch.slice(a, z - a)
            blocks = [lines(page.as_py() or "") for page in part.column("html")]
            texts, regions = [[t for t, _ in x] for x in blocks], [[code[r] for _, r in x] for x in blocks]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.list_(pa.string())), pa.array(regions, pa.list_(pa.int8()))], ["page_id", "url", "lines", "regions"])


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the urls before and after a url on its host, the one whose path shares the longer prefix."""
    for batch in batches:
        out = []
        for path, before, after in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "after")), strict=True):
            near = [x for x in (before, after) if x is not None]
            best = max(near, key=lambda x: len(commonprefix([x["path"], path])), default=None)
            out.append(best and best["name"])
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.string())], ["name", "near"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns each page with its neighbour; what is shared is confirmed by where it stands."""
    for batch in batches:
        texts = []
        for own, regions, other in zip(*(batch.column(c) for c in ("lines", "regions", "other")), strict=True):
            own, other = own.as_py(), other.as_py()
            common = shared([line_id(t) for t in own], other) if other else set()
            texts.append(confirmed(own, [REGIONS[r] for r in regions.as_py()], common))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def neighbours(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """name (of a url; "" if null) and near, the name of the neighbouring url (null: none)."""
    urls = parsed.select(F.coalesce("url", F.lit("")).alias("name"), "host", "path").distinct()
    placed = urls.repartitionByRange("host", "path", "name").withColumn("part", F.spark_partition_id())
    placed = scratch.store(placed, "urls")
    me = F.struct("path", "name", "host")
    order = Window.partitionBy("part").orderBy("host", "path", "name")
    # The ends of the parts, two rows for each, meet over the borders.
    ends = placed.groupBy("part").agg(F.min(F.struct("host", "path", "name")).alias("low"), F.max(F.struct("host", "path", "name")).alias("high"))
    over = Window.orderBy("part")
    turn = lambda c: F.struct(F.col(c)["path"].alias("path"), F.col(c)["name"].alias("name"), F.col(c)["host"].alias("host"))
    ends = ends.select(F.col("part").alias("_part"), F.lag(turn("high")).over(over).alias("last"), F.lead(turn("low")).over(over).alias("next"))
    seen = placed.withColumn("before", F.lag(me).over(order)).withColumn("after", F.lead(me).over(order)).join(F.broadcast(ends), F.col("part") == F.col("_part"))
    same = lambda c: F.when(c["host"] == F.col("host"), c)
    seen = seen.select("name", "path", same(F.coalesce("before", "last")).alias("before"), same(F.coalesce("after", "next")).alias("after"))
    return seen.mapInArrow(_nearer, "name string, near string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    scratch = Scratch(pages.sparkSession, "pages")
    kind = dict(pages.dtypes)[id_col]
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), F.col(html_col).alias("html"))
    outlines = scratch.store(rows.mapInArrow(_outline, f"page_id {kind}, url string, host string, path string, ids array<long>"), "outlines")
    name = F.coalesce("url", F.lit("")).alias("name")
    near = scratch.store(neighbours(outlines, scratch).where("near IS NOT NULL"), "near")
    first = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.hash("ids"), "ids")
    wanted = near.select(F.col("near").alias("name")).distinct()
    lines_of = outlines.select("page_id", "ids", name).join(wanted, "name", "left_semi").groupBy("name").agg(F.min(first).alias("x")).select(F.col("name").alias("near"), F.col("x.ids").alias("other"))
    # A url of many pages is dealt to several parts; there are few of those.
    many = scratch.store(outlines.select(name).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select("name", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "many")
    parts = F.coalesce("parts", F.lit(1))
    known = near.join(lines_of, "near").join(F.broadcast(many), "name", "left").select("name", "other", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    parsed = rows.select("page_id", "url", "html").mapInArrow(_parse, f"page_id {kind}, url string, lines array<string>, regions array<tinyint>")
    asked = parsed.select("page_id", "url", name, "lines", "regions").join(F.broadcast(many), "name", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "lines"), parts).cast("int")).drop("parts")
    done = asked.join(known, ["name", "part"], "left").mapInArrow(_difference, f"page_id {kind}, url string, text string")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
