"""More of what a conversion decides, as relations: progress, names, people, headers, folders, fills, sizes and messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import geometry, text
from folioloom.operators import books
from folioloom.sources import images as source

from .base import FOUND, PAGES_SQL, pages, query, table
from .books import _PAIRS, TURNS, _labels, turns
from .pixels import PIX_SQL, pixels, row_arrays, ycbcr


@query(f"""WITH f AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, i) AS finished FROM {TURNS})
SELECT conv_id, i::BIGINT AS i, finished, max(finished) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS emitted FROM f""")
def ordered_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages finish in any order and are told of in book order: each when all before it have finished."""
    book = Window.partitionBy("conv_id")
    finished = F.row_number().over(book.orderBy(F.length("text").desc(), "i")).cast("long")
    return books.emitted(turns(spark, sf_dir).select("conv_id", "i", finished.alias("finished")), ["conv_id"], "i", "finished")


@query(f"{_PAIRS} SELECT conv_id, string_agg('position ' || p || ': ' || outcome, '; ' ORDER BY p) AS told FROM walk WHERE outcome <> 'joined' GROUP BY conv_id")
def label_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a book is told about labels that could not be used."""
    skipped = books.spread_pairs(_labels(spark, sf_dir), ["conv_id"], "p", "total").where("outcome <> 'joined'")
    told = F.transform(F.array_sort(F.collect_list(F.struct("p", "outcome"))), lambda x: F.concat(F.lit("position "), x["p"].cast("string"), F.lit(": "), x["outcome"]))
    return skipped.groupBy("conv_id").agg(F.array_join(told, "; ").alias("told"))


_LONG = "repeat('é', (c_custkey % 200)::BIGINT) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' . ' ELSE '-' END || repeat('x. ', (c_custkey % 30)::BIGINT) || c_name"


@query(f"""SELECT c_custkey, regexp_replace(substr(s, 1, len(list_filter(range(1, length(s) + 1), lambda i: strlen(substr(s, 1, i)) <= 244))), '[. ]+$', '') || '.kepub.epub' AS name FROM (SELECT c_custkey, {_LONG} AS s FROM customer)""")
def generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within 255 bytes, cut between characters."""
    k = F.col("c_custkey")
    mark = F.when(k % 3 == 0, "").when(k % 3 == 1, " . ").otherwise("-")
    long_ = F.concat(F.repeat(F.lit("é"), (k % 200).cast("int")), mark, F.repeat(F.lit("x. "), (k % 30).cast("int")), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.generated_name(long_, "", ".kepub.epub").alias("name"))


@query("SELECT p_partkey, 'Book ' || p_size || CASE n WHEN 1 THEN '' WHEN 2 THEN ' (folioloom)' ELSE ' (folioloom ' || n - 1 || ')' END || '.cbz' AS name FROM (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part)")
def collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of one name get numbered suffixes."""
    turn = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").select("p_partkey", text.alternate_name(F.concat(F.lit("Book "), F.col("p_size").cast("string")), ".cbz", turn).alias("name"))


_ODD = "CASE p_partkey % 8 WHEN 0 THEN 'con.cbz' WHEN 1 THEN p_name || '. ' WHEN 2 THEN repeat('a', 250 + p_size) WHEN 3 THEN 'a:' || p_name WHEN 4 THEN 'LPT1' WHEN 5 THEN 'tab' || chr(9) WHEN 6 THEN p_name || '.' ELSE p_name || '.epub' END"


@query(f"SELECT p_partkey, NOT (strlen(s) > 255 OR regexp_matches(s, '[\\x00-\\x1f\\x7f<>:\"/\\\\|?*]') OR regexp_matches(s, '[. ]$') OR regexp_matches(lower(trim(split_part(s, '.', 1))), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$')) AS valid FROM (SELECT p_partkey, {_ODD} AS s FROM part)")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name that was asked for can be a file's on any system."""
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    odd = F.when(k == 0, "con.cbz").when(k == 1, F.concat(n, F.lit(". "))).when(k == 2, F.repeat(F.lit("a"), (250 + F.col("p_size")).cast("int"))).when(k == 3, F.concat(F.lit("a:"), n)).when(k == 4, "LPT1").when(k == 5, "tab\t").when(k == 6, F.concat(n, F.lit("."))).otherwise(F.concat(n, F.lit(".epub")))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_valid_name(odd).alias("valid"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_brand || ', ' || p_type || ', ,' || ' Ed' || ', ' || p_brand || ', ' || p_name, ', '), lambda x: trim(x)), lambda x: x NOT IN ('', ',')))), '; ') AS people FROM part")
def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several roles, each once, in order of code points."""
    roles = [F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type")), F.lit(", Ed"), F.concat(F.col("p_brand"), F.lit(", "), F.col("p_name"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.people(*roles), "; ").alias("people"))


_HEADS = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "474946383761", "424D", "524946460000000057454250", "00"]


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'bmp' WHEN 5 THEN 'webp' ELSE 'none' END AS kind FROM part")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of images by what their files begin with, whatever their names."""

    @F.pandas_udf("string")
    def kind(data: pd.Series) -> pd.Series:
        return data.map(lambda b: source.sniff(bytes(b)) or "none")

    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", kind(F.unhex(F.concat(head, F.lit("0102030405060708")))).alias("kind"))


@query(f"SELECT p_partkey, w, h FROM ({PAGES_SQL})")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by headers alone: of PNG, GIF and BMP in turn."""

    @F.pandas_udf("w long, h long")
    def size(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([source.dimensions(bytes(b)) or (None, None) for b in data], columns=["w", "h"]).astype("Int64")

    wide = lambda c, n: F.lpad(F.hex(F.col(c)), n, "0")
    turned = lambda c, n: F.array_join(F.reverse(F.regexp_extract_all(wide(c, n), F.lit("(..)"), 1)), "")
    k = F.col("p_partkey") % 3
    data = F.when(k == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide("w", 8), wide("h", 8), F.lit("0800000000"))).when(k == 1, F.concat(F.lit("474946383961"), turned("w", 4), turned("h", 4), F.lit("000000"))).otherwise(F.concat(F.lit("424D00000000000000003600000028000000"), turned("w", 8), turned("h", 8), F.lit("0100180000000000")))
    return pages(spark, sf_dir).select("p_partkey", size(F.unhex(data)).alias("s")).select("p_partkey", "s.w", "s.h")


_DIR = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '../' || p_brand || '/./c' || p_size WHEN 2 THEN 'a\\b/c' WHEN 3 THEN '//x//' || p_name ELSE p_brand END"
_FOLDER = f"array_to_string(list_transform(list_filter(string_split({_DIR}, '/'), lambda p: p NOT IN ('', '.', '..')), lambda p: replace(p, '\\', '-')), '/')"


@query(f"SELECT p_partkey, CASE WHEN f = '' THEN replace(replace('A/B ' || p_size, '/', '-'), '\\', '-') ELSE f END AS folder FROM (SELECT p_partkey, p_size, {_FOLDER} AS f FROM part)")
def chapter_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of chapters in an archive: plain components only, the title where there are none."""
    k, c = F.col("p_partkey") % 5, F.col
    directory = F.when(k == 0, "").when(k == 1, F.concat(F.lit("../"), c("p_brand"), F.lit("/./c"), c("p_size").cast("string"))).when(k == 2, "a\\b/c").when(k == 3, F.concat(F.lit("//x//"), c("p_name"))).otherwise(c("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.chapter_folder(directory, F.concat(F.lit("A/B "), c("p_size").cast("string"))).alias("folder"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' ELSE 'none' END AS media FROM part")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "jpeg", "png", "gif", "webp", "bmp"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(text.media_type(ext), F.lit("none")).alias("media"))


@query("SELECT p_partkey, p_size % 2 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 3 <> 0) AS black FROM part")
def border_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the room beside a page is black: asked for, or the page is dark and white is not asked for."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", geometry.fill_is_black(size % 2 == 0, key % 3 == 0, key % 2 == 0).alias("black"))


@query(f"SELECT vec_id % 16 AS image, channel, level, count(*) AS n FROM (UNPIVOT ({FOUND['ycbcr'][1]}) ON cb, cr INTO NAME channel VALUE level) GROUP BY ALL")
def chroma_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the two chroma levels of 16 images."""
    levels = ycbcr(spark, sf_dir).select((F.col("vec_id") % 16).alias("image"), F.explode(F.create_map(F.lit("cb"), "cb", F.lit("cr"), "cr")).alias("channel", "level"))
    return levels.groupBy("image", "channel", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id // 8 AS image, x FROM {PIX_SQL} GROUP BY ALL HAVING max(v) <= 200")
def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of images of 8 rows in which nothing is light."""
    return pixels(spark, sf_dir).groupBy(F.expr("vec_id div 8").alias("image"), "x").agg(F.max("v").alias("most")).where("most <= 200").select("image", "x")


@query(f"WITH e AS (SELECT vec_id // 8 AS image, x FROM {PIX_SQL} GROUP BY ALL HAVING max(v) <= 200) SELECT DISTINCT vec_id // 8 AS image, x FROM {PIX_SQL} EXCEPT SELECT image, x FROM e")
def kept_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that stay when empty ones go."""
    every = row_arrays(spark, sf_dir).select(F.expr("vec_id div 8").alias("image"), F.explode(F.sequence(F.lit(0).cast("long"), F.size("v").cast("long") - 1)).alias("x")).distinct()
    return every.join(empty_columns(spark, sf_dir), ["image", "x"], "left_anti")


@query(f"SELECT conv_id, arg_min(text, i) AS first_text, count(*) AS n_pages, sum(length(text))::BIGINT AS total FROM {TURNS} GROUP BY conv_id")
def book_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each book its first page, the number of pages and the sum of their sizes."""
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "i").alias("first_text"), F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("text")).alias("total"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'split_first,split_second' WHEN 2 THEN 'rotated' ELSE 'rotated,split_first,split_second' END AS roles FROM part")
def rotated_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces in order where the whole spread comes before its halves."""
    decided = F.element_at(F.array(*map(F.lit, ("normal", "split", "rotate", "both"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(geometry.rotate_first(geometry.roles(decided)), ",").alias("roles"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE lower(c_name || 'ÉÑÇ') END AS field FROM customer")
def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without the white space around them, null if nothing is left, as keys in lower case."""
    raw = F.concat(F.lit(" \t\n　"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.col("c_name"), F.lit("ÉÑÇ"))), F.lit("  \r"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.lower(text.clean(raw)), F.lit("-")).alias("field"))


@query(f"SELECT p_partkey, w + nw AS width, greatest(h, nh) AS height FROM (SELECT p_partkey, w, h, lead(w) OVER p AS nw, lead(h) OVER p AS nh, row_number() OVER p AS n FROM ({PAGES_SQL}) WINDOW p AS (PARTITION BY p_brand ORDER BY p_partkey)) WHERE n % 2 = 1 AND nw IS NOT NULL")
def joined_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvases of pages joined with the next one, side by side."""
    p = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = pages(spark, sf_dir).select("p_partkey", "w", "h", F.lead("w").over(p).alias("nw"), F.lead("h").over(p).alias("nh"), F.row_number().over(p).alias("n")).where("n % 2 = 1 AND nw IS NOT NULL")
    return rows.select("p_partkey", (F.col("w") + F.col("nw")).cast("long").alias("width"), F.greatest("h", "nh").cast("long").alias("height"))


@query(f"SELECT p_partkey, w // 2 AS width, 2 * h AS height FROM ({PAGES_SQL}) WHERE w > h")
def stacked_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide pages with one half on the other; an odd last column is lost."""
    s = geometry.stacked(F.col("w"), F.col("h"))
    return pages(spark, sf_dir).where("w > h").select("p_partkey", s["width"].cast("long").alias("width"), s["height"].cast("long").alias("height"))


@query(f"""WITH c AS (SELECT p_brand, w, count(*) AS n FROM ({PAGES_SQL}) GROUP BY ALL), m AS (SELECT p_brand, min(w) AS width FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS most FROM c) WHERE n = most GROUP BY p_brand)
SELECT p_brand, width, least(sum(h), 524288)::BIGINT AS height FROM ({PAGES_SQL}) JOIN m USING (p_brand) GROUP BY ALL""")
def strip_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvases of whole chapters as strips: the most common width, the heights together as far as the limit goes."""
    rows = pages(spark, sf_dir)
    widths = rows.groupBy("p_brand", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    best = F.min(F.struct(-F.col("n"), F.col("w").alias("w")))
    out = widths.groupBy("p_brand").agg(best.alias("b"), F.sum("h").alias("total"))
    return out.select("p_brand", F.col("b.w").cast("long").alias("width"), F.least("total", F.lit(524_288)).cast("long").alias("height"))


@query(f"SELECT conv_id, role, count(*) FILTER (length(text) > 60) AS n FROM {TURNS} GROUP BY ALL HAVING count(*) FILTER (length(text) > 60) > 0")
def chapters_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that have pages left."""
    return turns(spark, sf_dir).where(F.length("text") > 60).groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
