"""Names, titles, identifiers and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text

from .base import query, table

_ZERO = "CASE WHEN regexp_matches({0}, '^[+-]') THEN substr({0}, 1, 1) || repeat('0', greatest({1} - length({0}), 0)::BIGINT) || substr({0}, 2) ELSE repeat('0', greatest({1} - length({0}), 0)::BIGINT) || {0} END"
_NUMBER = "(CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '' END || (o_orderkey % 1200)::VARCHAR || CASE WHEN o_orderkey % 7 = 0 THEN '.5' ELSE '' END)"


def _number() -> Column:
    k = F.col("o_orderkey")
    return F.concat(F.when(k % 5 == 0, "-").when(k % 5 == 1, "+").otherwise(""), (k % 1200).cast("string"), F.when(k % 7 == 0, ".5").otherwise(""))


@query(f"SELECT o_orderkey, {_ZERO.format('n', 3)} AS filled FROM (SELECT o_orderkey, {_NUMBER} AS n FROM orders)")
def zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.zero_fill(_number(), 3).alias("filled"))


_INFO = "(SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS series, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::VARCHAR END AS volume, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 300)::VARCHAR END AS number, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS own FROM part)"
_COMPOSED = "coalesce(series, 'Fallback') || coalesce(' Vol. ' || " + _ZERO.format("volume", 2) + ", '') || coalesce(' #' || " + _ZERO.format("number", 3) + ", '')"


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    unless = lambda no, value: F.when(~no, value)
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", unless(size % 5 == 0, F.col("p_brand")).alias("series"), unless(size % 3 == 0, size.cast("string")).alias("volume"), unless(key % 4 == 0, (key % 300).cast("string")).alias("number"), unless(key % 3 == 0, F.col("p_name")).alias("own"))


@query(f"SELECT p_partkey, mode, CASE mode WHEN 'title_only' THEN coalesce(own, 'Fallback') WHEN 'combine' THEN {_COMPOSED} || coalesce(': ' || own, '') ELSE {_COMPOSED} END AS title FROM {_INFO} CROSS JOIN (VALUES ('series_only'), ('combine'), ('title_only')) AS m(mode)")
def title_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _info(spark, sf_dir).withColumn("mode", F.explode(F.array(*map(F.lit, ("series_only", "combine", "title_only")))))
    c = F.col
    return rows.select("p_partkey", "mode", text.title(c("series"), c("volume"), c("number"), c("own"), F.lit("Fallback"), c("mode")).alias("title"))


@query(f"SELECT p_partkey, coalesce(volume || '.' || number, volume, number, '-') AS position FROM {_INFO}")
def series_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(spark, sf_dir).select("p_partkey", F.coalesce(text.series_position(F.col("volume"), F.col("number")), F.lit("-")).alias("position"))


@query(f"""SELECT p_partkey, asked, CASE WHEN mode = 'title_only' AND own IS NOT NULL THEN own WHEN asked <> '' THEN asked WHEN mode = 'title_only' THEN 'Fallback' ELSE {_COMPOSED} END AS title, CASE WHEN asked = '' AND mode <> 'title_only' THEN coalesce(volume || '.' || number, volume, number, '-') ELSE '-' END AS position
FROM {_INFO} CROSS JOIN (VALUES ('', 'series_only'), ('Mine', 'series_only'), ('Mine', 'title_only')) AS m(asked, mode)""")
def metadata_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asked title wins over metadata, but not in title-only mode; a position comes with a title from metadata only."""
    modes = F.array(*[F.struct(F.lit(a).alias("asked"), F.lit(m).alias("mode")) for a, m in (("", "series_only"), ("Mine", "series_only"), ("Mine", "title_only"))])
    rows = _info(spark, sf_dir).withColumn("m", F.explode(modes)).select("*", "m.*")
    c = F.col
    free = c("asked") == ""
    fallback = F.when(free, "Fallback").otherwise(c("asked"))
    composed = text.title(c("series"), c("volume"), c("number"), c("own"), F.lit("Fallback"), c("mode"))
    title = F.when(c("mode") == "title_only", F.coalesce(c("own"), fallback)).when(free, composed).otherwise(c("asked"))
    position = F.when(free & (c("mode") != "title_only"), text.series_position(c("volume"), c("number")))
    return rows.select("p_partkey", "asked", title.alias("title"), F.coalesce(position, F.lit("-")).alias("position"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.xml_escape(F.col("html"))).alias("escaped"))


@query("SELECT page_id, translate(url, '/\\?%*:;|\"''><$!', '______________') AS stem FROM pages")
def kobo_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


_STEM = "CASE p_partkey % 6 WHEN 0 THEN 'con' WHEN 1 THEN p_name || '. .' WHEN 2 THEN '...' WHEN 3 THEN 'a/b:' || p_name WHEN 4 THEN 'LPT1.txt' ELSE p_name || '?' END"
_CLEAN = f"regexp_replace(regexp_replace({_STEM}, '[<>:\"/\\\\|?*]', '-', 'g'), '[. ]+$', '')"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(lower(trim(split_part(s, '.', 1))), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN '_' || s ELSE s END AS stem FROM (SELECT p_partkey, CASE WHEN {_CLEAN} = '' THEN 'book' ELSE {_CLEAN} END AS s FROM part)")
def portable_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    raw = F.when(k == 0, "con").when(k == 1, F.concat(n, F.lit(". ."))).when(k == 2, "...").when(k == 3, F.concat(F.lit("a/b:"), n)).when(k == 4, "LPT1.txt").otherwise(F.concat(n, F.lit("?")))
    return table(spark, sf_dir, "part").select("p_partkey", text.portable_stem(raw).alias("stem"))


@query("SELECT c_custkey, 'FEFF' || regexp_replace(hex(encode(c_name)), '(..)', '00\\1', 'g') AS pdf FROM customer")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.pdf_text(F.col("c_name")).alias("pdf"))


_SHA = f"sha1(unhex('{text.NAMESPACE.replace('-', '')}') || encode(c_name || chr(0) || c_mktsegment))"


@query(f"SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN strpos('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT c_custkey, {_SHA} AS h FROM customer)")
def uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.concat(F.col("c_name"), F.lit("\x00"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.uuid5(seed).alias("id"))


@query("SELECT event_id, strftime(make_timestamp(greatest(floor(epoch(ts))::BIGINT - CASE WHEN event_id % 9 = 0 THEN 4000000000 ELSE 0 END, 0) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as UTC text; what lies before 1970 is 1970."""
    s = F.unix_seconds(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 9 == 0, 4_000_000_000).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", text.utc_stamp(s).alias("stamp"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 50 || ',' || o_orderkey % 70 WHEN 1 THEN '' ELSE 'unreadable' END AS labels FROM orders""")
def labels_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages in JSON; a value that is no whole number from 0 up makes the whole list unreadable."""
    k = F.col("o_orderkey")
    one = (k % 50).cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"spreads":['), one, F.lit(","), (k % 70).cast("string"), F.lit("]}"))).when(k % 4 == 1, '{"spreads":[]}').when(k % 4 == 2, F.concat(F.lit('{"spreads":["'), one, F.lit('"]}'))).otherwise('{"spreads":[-3]}')
    items = F.from_json(raw, "spreads array<string>")["spreads"]
    quoted = F.contains(raw, F.lit('["'))
    sound = F.forall(items, lambda x: x.rlike("^[0-9]+$")) & ~quoted
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.coalesce(sound, F.lit(False)), F.array_join(items, ",")).otherwise("unreadable").alias("labels"))


@query("SELECT p_partkey, nullif(trim(p_brand), '') AS series, p_size::VARCHAR AS number, NULL::VARCHAR AS title, 'A; B' AS people, 1::INTEGER AS bookmarks FROM part")
def comicinfo_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents written from parts and read again with a fixed schema."""
    c = F.col
    xml = F.concat(F.lit("<ComicInfo><Series> "), text.xml_escape(c("p_brand")), F.lit(" </Series><Number>"), c("p_size").cast("string"), F.lit("</Number><Title/><Writer>B, A, B</Writer><Pages><Page Image='0' Bookmark='Start'/><Page Image='x'/></Pages></ComicInfo>"))
    schema = "Series string, Number string, Title string, Writer string, Pages struct<Page array<struct<_Image string, _Bookmark string>>>"
    read = F.from_xml(xml, schema)
    people = F.array_sort(F.array_distinct(F.transform(F.split(read["Writer"], ", "), lambda n: F.trim(n))))
    marks = F.filter(read["Pages"]["Page"], lambda p: p["_Image"].rlike("^[0-9]+$") & (p["_Bookmark"] != ""))
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.trim(read["Series"]), F.lit("")).alias("series"), read["Number"].alias("number"), F.nullif(F.trim(read["Title"]), F.lit("")).alias("title"), F.array_join(people, "; ").alias("people"), F.size(marks).alias("bookmarks"))
