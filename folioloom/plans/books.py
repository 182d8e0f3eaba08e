"""Books, chapters and pages: grouping, numbering, sides, joins, filters and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import natural, text
from folioloom.operators import books

from .base import PAGES_SQL, pages, query, table

#: Turns of conversations are pages of books.
ROLE = "CASE WHEN role = 'user' THEN 'normal' WHEN role = 'system' THEN 'rotated' WHEN turn % 2 = 0 THEN 'split_first' ELSE 'split_second' END"
TURNS = f"(SELECT conv_id, turn, role, text, {ROLE} AS page_role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)"
#: Paths of pages: host, language, page file.
PATHS = "(SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.expr(ROLE).alias("page_role"), i.alias("i"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query(f"""
WITH t AS (SELECT *, CASE WHEN page_role <> 'normal' THEN i END AS s FROM {TURNS}),
n AS (SELECT *, min(s) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(s) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv FROM t)
SELECT conv_id, i::BIGINT AS i, CASE page_role WHEN 'split_first' THEN 'right' WHEN 'split_second' THEN 'left' WHEN 'rotated' THEN 'center' ELSE
  CASE WHEN nxt IS NOT NULL THEN CASE WHEN (nxt - i - 1) % 2 = 0 THEN 'left' ELSE 'right' END WHEN prv IS NOT NULL THEN CASE WHEN (i - prv - 1) % 2 = 0 THEN 'right' ELSE 'left' END ELSE CASE WHEN i % 2 = 0 THEN 'left' ELSE 'right' END END END AS side FROM n""")
def page_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of pages in a right-to-left book that starts on its second side."""
    return books.page_sides(turns(spark, sf_dir), ["conv_id"], "i", "page_role", True, True).select("conv_id", "i", "side")


@query(f"SELECT conv_id, i::BIGINT AS i, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS in_book, row_number() OVER (PARTITION BY conv_id, role ORDER BY i) AS in_chapter FROM {TURNS}")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.page_numbers(turns(spark, sf_dir), ["conv_id"], ["role"], ["i"]).select("conv_id", "i", "in_book", "in_chapter")


@query(f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS source, i::BIGINT AS start FROM {TURNS} WHERE page_role <> 'split_second'")
def source_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First output page of each source page; second halves continue one."""
    rows = turns(spark, sf_dir).withColumn("continues", F.col("page_role") == "split_second")
    return books.source_starts(rows, ["conv_id"], ["i"], "continues")


@query(f"""
WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS source, i AS start FROM {TURNS} WHERE page_role <> 'split_second')
SELECT t.conv_id, t.i::BIGINT AS mark, s.start::BIGINT AS target FROM {TURNS} t JOIN s ON s.conv_id = t.conv_id AND s.source = t.i * 2""")
def bookmark_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks on every second source page; those that name no page go."""
    rows = turns(spark, sf_dir)
    starts = books.source_starts(rows.withColumn("continues", F.col("page_role") == "split_second"), ["conv_id"], ["i"], "continues")
    marks = rows.select("conv_id", F.col("i").alias("mark"), (F.col("i") * 2).alias("source"))
    return marks.join(starts, ["conv_id", "source"]).select("conv_id", "mark", F.col("start").alias("target"))


_LABELS = f"(SELECT DISTINCT conv_id, i + length(text) % 2 AS p, count(*) OVER (PARTITION BY conv_id) AS total FROM {TURNS})"
_PAIRS = f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS n FROM {_LABELS}),
walk AS (SELECT conv_id, p, n, p + 1 < total AS joined, CASE WHEN p + 1 >= total THEN 'no_page_after' ELSE 'joined' END AS outcome FROM l WHERE n = 1
  UNION ALL SELECT l.conv_id, l.p, l.n, l.p + 1 < l.total AND NOT (w.joined AND w.p = l.p - 1), CASE WHEN l.p + 1 >= l.total THEN 'no_page_after' WHEN w.joined AND w.p = l.p - 1 THEN 'part_of_previous_pair' ELSE 'joined' END FROM walk w JOIN l ON l.conv_id = w.conv_id AND l.n = w.n + 1)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    total = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", (F.col("i") + F.length("text") % 2).alias("p"), total.alias("total"))


@query(f"{_PAIRS} SELECT conv_id, p::BIGINT AS p, outcome FROM walk")
def spread_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labelled pages are joined with the next one."""
    return books.spread_pairs(_labels(spark, sf_dir), ["conv_id"], "p", "total").select("conv_id", "p", "outcome")


@query(f"{_PAIRS} SELECT t.conv_id, t.i::BIGINT AS i, (t.i - (SELECT count(*) FROM walk w WHERE w.conv_id = t.conv_id AND w.joined AND w.p < t.i))::BIGINT AS after FROM {TURNS} t")
def position_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages stand once pairs are joined."""
    joined = books.spread_pairs(_labels(spark, sf_dir), ["conv_id"], "p", "total").where("outcome = 'joined'").select("conv_id", F.col("p").alias("i"))
    return books.position_after(turns(spark, sf_dir), joined, ["conv_id"], "i")


_DIRS = f"(SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir FROM {PATHS})"


@query(f"SELECT dir AS chapter, CASE WHEN dir = '' THEN 'Untitled' ELSE split_part(dir, '/', -1) END AS title, row_number() OVER (ORDER BY f) AS n, c AS n_pages FROM (SELECT dir, min(page_id) AS f, count(*) AS c FROM {_DIRS} GROUP BY dir)")
def chapters_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories as chapters, by their first page."""
    rows = paths(spark, sf_dir).withColumn("chapter", books.parent(F.col("path")))
    seen = books.first_seen(rows, [], ["chapter"], "page_id", "n")
    counted = rows.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_pages"))
    return seen.join(counted, "chapter").select("chapter", books.chapter_title(F.col("chapter")).alias("title"), "n", "n_pages")


_VOLUME = "CASE WHEN NOT contains(dir, '/') THEN 'Untitled' ELSE split_part(regexp_extract(dir, '^(.*)/[^/]*$', 1), '/', -1) END"


@query(f"SELECT volume, row_number() OVER (ORDER BY f) AS n, c AS n_chapters FROM (SELECT {_VOLUME} AS volume, min(page_id) AS f, count(DISTINCT dir) AS c FROM {_DIRS} GROUP BY ALL)")
def volumes_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories above chapters as volumes; equal names are one volume."""
    rows = paths(spark, sf_dir).withColumn("chapter", books.parent(F.col("path"))).withColumn("volume", books.volume_title(F.col("chapter")))
    seen = books.first_seen(rows, [], ["volume"], "page_id", "n")
    counted = rows.select("volume", "chapter").distinct().groupBy("volume").agg(F.count(F.lit(1)).alias("n_chapters"))
    return seen.join(counted, "volume")


@query(f"SELECT page_id, dir, CASE WHEN k > 1 THEN dir || ' (' || k || ')' ELSE dir END AS unique_folder FROM (SELECT page_id, dir, row_number() OVER (PARTITION BY dir ORDER BY page_id) AS k FROM {_DIRS})")
def folder_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths(spark, sf_dir).select("page_id", books.parent(F.col("path")).alias("dir"))
    return books.occurrence_suffix(rows, [], "dir", "page_id")


@query(f"SELECT t.page_id, o.n AS play_order FROM {_DIRS} t JOIN (SELECT dir, row_number() OVER (ORDER BY min(page_id)) AS n FROM {_DIRS} GROUP BY dir) o USING (dir)")
def play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets numbered when first met; later mentions have the same number."""
    rows = paths(spark, sf_dir).select("page_id", books.parent(F.col("path")).alias("dir"))
    return rows.join(books.first_seen(rows, [], ["dir"], "page_id", "play_order"), "dir").select("page_id", "play_order")


@query(f"SELECT page_id, CASE WHEN dir = '' THEN 'The book' ELSE split_part(dir, '/', -1) END AS label FROM {_DIRS}")
def chapter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = books.parent(F.col("path"))
    return paths(spark, sf_dir).select("page_id", F.when(directory == "", "The book").otherwise(books.chapter_title(directory)).alias("label"))


_FILES = "(SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN '__MACOSX/' ELSE 'c' || p_size || '/' END || CASE WHEN p_partkey % 13 = 0 THEN '._' ELSE '' END || replace(p_name, ' ', '-') || CASE p_partkey % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' WHEN 3 THEN '-kcc.jpeg' WHEN 4 THEN '.tar.webp' ELSE '' END AS path FROM part)"
_IS_IMAGE = "regexp_matches(lower(split_part(path, '/', -1)), '^.+\\.(jpg|jpeg|png|gif|bmp|webp)$') AND NOT list_contains(string_split(path, '/'), '__MACOSX') AND NOT starts_with(split_part(path, '/', -1), '._')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tail = F.element_at(F.array(*map(F.lit, (".PNG", ".jpg", ".txt", "-kcc.jpeg", ".tar.webp", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    folder = F.when(F.col("p_size") % 11 == 0, "__MACOSX/").otherwise(F.concat(F.lit("c"), F.col("p_size").cast("string"), F.lit("/")))
    return part.select("p_partkey", F.concat(folder, F.when(F.col("p_partkey") % 13 == 0, "._").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")), tail).alias("path"))


@query(f"SELECT p_partkey, path FROM {_FILES} WHERE {_IS_IMAGE}")
def page_image_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(text.is_page_image(F.col("path")))


@query(f"SELECT count(*) FILTER ({_IS_IMAGE}) AS kept, count(*) FILTER (NOT ({_IS_IMAGE})) AS skipped FROM {_FILES}")
def skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).agg(F.count_if(text.is_page_image(F.col("path"))).alias("kept"), F.count_if(~text.is_page_image(F.col("path"))).alias("skipped"))


@query(f"SELECT bool_or(contains(regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1'), '-kcc')) AS converted, count(*) FILTER (contains(regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1'), '-kcc')) AS n FROM {_FILES}")
def already_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.contains(text.stem(F.col("path")), F.lit("-kcc"))
    return files(spark, sf_dir).agg(F.bool_or(marked).alias("converted"), F.count_if(marked).alias("n"))


@query(f"SELECT p_brand, count(*) FILTER (w < 1264 AND h < 1680) AS smaller, count(w) AS measured, count(*) FILTER (w < 1264 AND h < 1680) * 4 > count(w) AS warn FROM ({PAGES_SQL}) GROUP BY p_brand")
def smaller_than_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each book: pages smaller than the screen both ways, pages measured, and whether that calls for a warning."""
    small = F.count_if((F.col("w") < 1264) & (F.col("h") < 1680))
    return pages(spark, sf_dir).groupBy("p_brand").agg(small.alias("smaller"), F.count("w").alias("measured"), (small * 4 > F.count("w")).alias("warn"))


_NAME = "'Vol. ' || (c_custkey % 13) || ' p' || CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '' END || c_custkey // 3"


@query(f"""
WITH n AS (SELECT c_custkey, c_nationkey, {_NAME} AS name FROM customer),
k AS (SELECT *, list_aggregate(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN chr(1) || lpad(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END, 20, '0') ELSE p || chr(1) END), 'string_agg', '') AS key FROM n)
SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, name, row_number() OVER (PARTITION BY c_nationkey ORDER BY key, c_custkey) AS place FROM k""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in natural order within nations; equal keys keep their order."""
    name = F.concat(F.lit("Vol. "), (F.col("c_custkey") % 13).cast("string"), F.lit(" p"), F.when(F.col("c_custkey") % 2 == 0, "0").otherwise(""), F.expr("c_custkey div 3").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), name.alias("name"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("key", "c_custkey")).cast("long")
    return rows.withColumn("key", natural.natural_key("name")).withColumn("place", place).drop("key")


_PATH = """CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Vol. ' || c_custkey % 13 || '/' END AS folder,
  CASE c_custkey % 4 WHEN 0 THEN 'p' || c_custkey // 7 WHEN 1 THEN 'P0' || c_custkey // 7 WHEN 2 THEN translate((c_custkey // 7)::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE 'p' || c_custkey // 7 || '²' END AS page,
  CASE c_custkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.tar.gz' ELSE '.JPG' END AS ending"""


def _piece(x: str) -> str:
    """Key of a piece whose numbers have under 20 digits."""
    plain = f"translate(lower({x}), '٠١٢٣٤٥٦٧٨٩', '0123456789')"
    numbers = f"list_aggregate(list_transform(regexp_extract_all({plain}, '²|[0-9]+|[^0-9²]+'), lambda p: CASE WHEN p = '²' THEN chr(1) || chr(1) || lpad('2', 20, '0') WHEN regexp_matches(p, '^[0-9]') THEN chr(1) || chr(1) || lpad(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END, 20, '0') ELSE p END), 'string_agg', '')"
    return f"coalesce({numbers}, '') || CASE WHEN regexp_matches({plain}, '[^0-9²]$') THEN chr(1) ELSE '' END"


@query(f"""
WITH n AS (SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, {_PATH} FROM customer),
k AS (SELECT *, {_piece("folder")} AS f, {_piece("page")} AS s, {_piece("regexp_extract(ending, '^([.][a-zA-Z]+)', 1)")} AS a, {_piece("regexp_extract(ending, '^[.][a-zA-Z]+(.*)$', 1)")} AS b FROM n)
SELECT c_custkey, c_nationkey, folder || page || ending AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY folder <> '', f, s, a, b, c_custkey) AS place FROM k""")
def natural_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in natural order within nations: files before folders, digits of another script, superscripts, one and two extensions."""
    n, page = F.col("c_custkey"), F.expr("cast(c_custkey div 7 AS string)")
    folder = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("Vol. "), (n % 13).cast("string"), F.lit("/")))
    name = F.when(n % 4 == 0, F.concat(F.lit("p"), page)).when(n % 4 == 1, F.concat(F.lit("P0"), page)).when(n % 4 == 2, F.translate(page, "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(F.concat(F.lit("p"), page, F.lit("²")))
    ending = F.when(n % 3 == 0, ".png").when(n % 3 == 1, ".tar.gz").otherwise(".JPG")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.concat(folder, name, ending).alias("path"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("key", "c_custkey")).cast("long")
    return rows.withColumn("key", natural.natural_key("path")).withColumn("place", place).drop("key")


@query("SELECT s_name AS book, replace(upper(s_name), 'SUPPLIER', 'supplier') AS cover, 'name' AS how FROM supplier WHERE s_suppkey % 5 = 0")
def covers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers that bear a book's name, whatever the case."""
    s = table(spark, sf_dir, "supplier")
    images = s.where("s_suppkey % 5 = 0").select(F.replace(F.upper("s_name"), F.lit("SUPPLIER"), F.lit("supplier")).alias("name"), F.col("s_suppkey").alias("ord"))
    return books.covers(s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")), images)


@query("SELECT n_name AS book, r_name AS cover, 'rank' AS how FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) USING (k) WHERE NOT EXISTS (SELECT 1 FROM nation a JOIN region b ON lower(a.n_name) = lower(b.r_name))")
def covers_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers without a book's name, by their places in two lists."""
    named = lambda t, p: table(spark, sf_dir, t).select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_{t}key").alias("ord"))
    return books.covers(named("nation", "n"), named("region", "r"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS n FROM (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT // 60 AS s FROM events)),
w AS (SELECT user_id, n, s AS first, s AS last, NULL::BIGINT AS done_first, NULL::BIGINT AS done_last FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN w.first IS NULL THEN e.s WHEN e.s - w.last <= 300 THEN w.first END, CASE WHEN w.first IS NULL OR e.s - w.last <= 300 THEN e.s END, CASE WHEN w.first IS NOT NULL AND e.s - w.last > 300 THEN w.first END, CASE WHEN w.first IS NOT NULL AND e.s - w.last > 300 THEN w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, done_first AS first, done_last AS last FROM w WHERE done_first IS NOT NULL
UNION ALL SELECT w.user_id, w.first, w.last FROM w JOIN (SELECT user_id, max(n) AS n FROM e GROUP BY user_id) m ON m.user_id = w.user_id AND m.n = w.n WHERE w.first IS NOT NULL""")
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of a user's events in groups; the one that breaks a group is dropped."""
    minutes = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("s"))
    lists = minutes.groupBy("user_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return lists.select("user_id", F.explode(books.gap_groups(F.col("s"), 300)).alias("g")).select("user_id", "g.first", "g.last")


@query("""
WITH RECURSIVE d AS (SELECT source, lang, doc_id // 500 AS part, doc_id, n_chars AS h, row_number() OVER (PARTITION BY source, lang, doc_id // 500 ORDER BY doc_id) AS n FROM documents),
w AS (SELECT source, lang, part, doc_id, n, 0::BIGINT AS page, 8000 - h AS room FROM d WHERE n = 1
  UNION ALL SELECT d.source, d.lang, d.part, d.doc_id, d.n, CASE WHEN w.room - d.h > 0 THEN w.page ELSE w.page + 1 END, CASE WHEN w.room - d.h > 0 THEN w.room - d.h ELSE 8000 - d.h END FROM w JOIN d ON d.source = w.source AND d.lang = w.lang AND d.part = w.part AND d.n = w.n + 1)
SELECT doc_id, page FROM w""")
def webtoon_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a chapter's strip on pages, in order; chapters hold 500 identifiers of a source and language."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang", F.expr("doc_id div 500")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("d"))
    placed = rows.select(F.arrays_zip(F.col("d.doc_id").alias("doc_id"), books.greedy_pages(F.col("d.n_chars"), 8000).alias("page")).alias("z"))
    return placed.select(F.explode("z").alias("z")).select("z.doc_id", "z.page")


@query("SELECT c_nationkey::BIGINT AS nation, min(w)::BIGINT AS width FROM (SELECT c_nationkey, w, count(*) AS n, max(count(*)) OVER (PARTITION BY c_nationkey) AS most FROM (SELECT c_nationkey, c_custkey % 7 * 100 AS w FROM customer) GROUP BY c_nationkey, w) WHERE n = most GROUP BY c_nationkey")
def mode_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common width; the smallest on a tie."""
    widths = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), (F.col("c_custkey") % 7 * 100).alias("w"))
    counted = widths.groupBy("nation", "w").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("nation").agg(F.min(F.struct(-F.col("n"), F.col("w").alias("w"))).alias("b")).select("nation", F.col("b.w").alias("width"))


@query("SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS sequence, conv_id, '{\"type\":\"' || CASE role WHEN 'system' THEN 'warning' ELSE 'progress' END || '\",\"page\":' || turn || CASE WHEN role = 'system' THEN ',\"code\":\"page_truncated\"' ELSE '' END || '}' AS event FROM conversations")
def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON events with a gapless sequence; keys without a value are left out."""
    rows = table(spark, sf_dir, "conversations")
    sequence = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    event = F.to_json(F.struct(F.when(F.col("role") == "system", "warning").otherwise("progress").alias("type"), F.col("turn").alias("page"), F.when(F.col("role") == "system", "page_truncated").alias("code")))
    return rows.select(sequence.alias("sequence"), "conv_id", event.alias("event"))
