"""Relational operators on books, chapters and pages. Order is a column everywhere; groups are books or chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str, span: int = 65_536) -> DataFrame:
    """Numbers all rows from 1 by a whole-number column without gathering them: counts of spans of its values first, then rows within spans."""
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    counts = spans.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))  # a row for each span that has rows
    before = F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(F.col("_span").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_span").orderBy(order))
    return spans.withColumn("_in", inside).join(first, F.col("_span") == F.col("_s")).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_span", "_s", "_in", "_before")


def first_seen(df: DataFrame, book: list[str], group: list[str], order: str, name: str) -> DataFrame:
    """Numbers the groups of each book (of all rows, if no columns name it) from 1 by their first row; partial aggregation before the only shuffle of groups."""
    firsts = df.groupBy(*book, *group).agg(F.min(order).alias("_first"))
    if not book:
        return numbered(firsts, "_first", name).drop("_first")
    return firsts.withColumn(name, F.row_number().over(Window.partitionBy(*book).orderBy("_first")).cast("long")).drop("_first")


def parent(path: Column) -> Column:
    """Directory of a path, empty at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def chapter_title(directory: Column) -> Column:
    return F.when(directory == "", "Untitled").otherwise(F.element_at(F.split(directory, "/"), -1))


def volume_title(directory: Column) -> Column:
    """Name of the directory above the chapter's."""
    above = parent(directory)
    return F.when(above == "", "Untitled").otherwise(F.element_at(F.split(above, "/"), -1))


def page_numbers(pages: DataFrame, book: list[str], chapter: list[str], order: list[str]) -> DataFrame:
    """in_book and in_chapter from 1."""
    number = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return pages.withColumn("in_book", number(book)).withColumn("in_chapter", number([*book, *chapter]))


def emitted(pages: DataFrame, book: list[str], order: str, finished: str) -> DataFrame:
    """Adds `emitted`: when a page can be told of in order, which is when the last of it and those before it has finished."""
    before = Window.partitionBy(*book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("emitted", F.max(finished).over(before))


def source_starts(outputs: DataFrame, book: list[str], order: list[str], continues: str) -> DataFrame:
    """Of each source page of a book, its number from 0 and the place from 0 of its first output page."""
    place = F.row_number().over(Window.partitionBy(*book).orderBy(*order)).cast("long") - 1
    numbered = outputs.withColumn("start", place).where(~F.col(continues))
    return numbered.withColumn("source", F.row_number().over(Window.partitionBy(*book).orderBy("start")).cast("long") - 1).select(*book, "source", "start")


def page_sides(pages: DataFrame, book: list[str], order: str, role: str, right_to_left: bool, start_on_second: bool, one_page: bool = False) -> DataFrame:
    """Side of each page: left, right or center.

    Before the last spread, sides are counted back from the next page that is not normal; after it, on from that page; in a
    book without spreads from the first page. Alternation is the parity of a distance, so no row waits for another.
    """
    if one_page:
        return pages.withColumn("side", F.lit("center"))
    first, second = ("right", "left") if right_to_left else ("left", "right")
    w = Window.partitionBy(*book).orderBy(order)
    place = F.row_number().over(w)
    pages = pages.withColumn("_i", place).withColumn("_spread", F.when(F.col(role) != "normal", F.col("_i")))
    after = F.first("_spread", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("_spread", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.withColumn("_after", after).withColumn("_before", before)
    flips = F.when(F.col("_after").isNotNull(), F.col("_after") - F.col("_i")).when(F.col("_before").isNotNull(), F.col("_i") - F.col("_before") - 1).otherwise(F.col("_i") - 1 + F.lit(int(start_on_second)))
    normal = F.when(flips % 2 == 0, first).otherwise(second)
    side = F.when(F.col(role) == "normal", normal).when(F.col(role) == "split_first", first).when(F.col(role) == "split_second", second).otherwise("center")
    return pages.withColumn("side", side).drop("_i", "_spread", "_after", "_before")


def spread_pairs(labels: DataFrame, book: list[str], position: str, total: str) -> DataFrame:
    """What becomes of each labelled position: joined, part_of_previous_pair or no_page_after.

    In a run of successive labels every other one is joined; the last page has none after it.
    """
    one = labels.select(*book, position, total).distinct()
    w = Window.partitionBy(*book).orderBy(position)
    usable = F.col(position) + 1 < F.col(total)
    run = F.col(position) - F.row_number().over(w)
    one = one.withColumn("_run", run)
    inside = F.row_number().over(Window.partitionBy(*book, "_run").orderBy(position)) - 1
    return one.withColumn("outcome", F.when(~usable, "no_page_after").when(inside % 2 == 0, "joined").otherwise("part_of_previous_pair")).drop("_run")


def position_after(positions: DataFrame, joined: DataFrame, book: list[str], position: str) -> DataFrame:
    """Adds `after`: the position less the joined ones before it, by one sort of both."""
    both = positions.select(*book, position, F.lit(False).alias("_joined")).unionByName(joined.select(*book, position, F.lit(True).alias("_joined")))
    w = Window.partitionBy(*book).orderBy(position).rangeBetween(Window.unboundedPreceding, -1)
    less = F.coalesce(F.sum(F.col("_joined").cast("long")).over(w), F.lit(0))
    return both.withColumn("after", F.col(position) - less).where("NOT _joined").drop("_joined")


def occurrence_suffix(chapters: DataFrame, book: list[str], folder: str, order: str) -> DataFrame:
    """Adds `unique_folder`: a second folder of one name becomes `name (2)`, and so on."""
    n = F.row_number().over(Window.partitionBy(*book, folder).orderBy(order))
    return chapters.withColumn("unique_folder", F.when(n > 1, F.concat(F.col(folder), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(folder)))


def gap_groups(values: Column, tolerance) -> Column:
    """array of struct(first, last) of a sorted array: a value beyond the tolerance closes the group and is dropped."""
    start = F.struct(F.array().cast("array<struct<first:bigint,last:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    group = lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
    state = lambda done, a, b: F.struct(done.alias("done"), a.cast("bigint").alias("first"), b.cast("bigint").alias("last"))
    none = F.lit(None).cast("bigint")

    def step(s: Column, v: Column) -> Column:
        return F.when(s["first"].isNull(), state(s["done"], v, v)).when(v - s["last"] <= tolerance, state(s["done"], s["first"], v)).otherwise(state(F.concat(s["done"], F.array(group(s))), none, none))

    return F.aggregate(values, start, step, lambda s: F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(group(s)))))


def greedy_pages(heights: Column, page: int) -> Column:
    """array of the page numbers from 0 of heights in order; a height that would fill the room exactly begins a page. For the pieces of one chapter, which a strip bounds."""
    start = F.struct(F.array().cast("array<bigint>").alias("pages"), F.lit(0).cast("bigint").alias("page"), F.lit(page).cast("bigint").alias("room"), F.lit(True).alias("empty"))

    def step(s: Column, h: Column) -> Column:
        fits = s["room"] - h > 0
        at = F.when(fits | s["empty"], s["page"]).otherwise(s["page"] + 1)
        room = F.when(fits, s["room"] - h).otherwise(F.lit(page) - h)
        return F.struct(F.concat(s["pages"], F.array(at)).alias("pages"), at.alias("page"), room.cast("bigint").alias("room"), F.lit(False).alias("empty"))

    return F.aggregate(heights, start, step, lambda s: s["pages"])


def covers(books: DataFrame, images: DataFrame) -> DataFrame:
    """book, cover and how they met (name or rank).

    Names are compared in lower case; if any cover bears a book's name there are no others, else the n-th cover is the
    n-th book's. `books` and `images`: name and ord, one folder of each, so ranks are over a folder's list.
    """
    key = lambda df, as_: df.select(F.col("name").alias(as_), F.lower("name").alias("key"), F.col("ord").alias(f"{as_}_ord"))
    b, c = key(books, "book"), key(images, "cover")
    first = c.groupBy("key").agg(F.min_by("cover", "cover_ord").alias("cover"))
    named = b.join(first, "key").select("book", "cover", F.lit("name").alias("how"))
    any_named = named.select(F.lit(1).alias("x")).limit(1)
    rank = lambda df, o: numbered(df, o, "n")
    ranked = rank(b, "book_ord").join(rank(c, "cover_ord"), "n").join(F.broadcast(any_named), F.lit(True), "left_anti")
    return named.unionByName(ranked.select("book", "cover", F.lit("rank").alias("how")))
