"""Devices, decisions and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom import profiles
from folioloom.functions import geometry as G

from .base import PAGES_SQL, pages, query, table

FAMILY_SQL = "CASE WHEN code = 'OTHER' OR regexp_matches(code, '^[0-9]') THEN 'Other' WHEN starts_with(code, 'Rmk') THEN 'Remarkable' WHEN starts_with(code, 'Ko') THEN 'Kobo' ELSE 'Kindle' END"
#: Device, mode of the splitter, right to left, screen.
DEVICES = [("KV", "split", False), ("KDX", "both", True), ("RmkPP", "rotate", False)]
DEVICES_SQL = "(VALUES " + ", ".join(f"('{c}', '{m}', {str(r).lower()}, {profiles.PROFILES[c].width}, {1200 if c == 'KDX' else profiles.PROFILES[c].height})" for c, m, r in DEVICES) + ") AS devices(code, mode, rtl, tw, th)"
CONTAIN_W = "CASE WHEN w::DOUBLE / h >= tw::DOUBLE / th THEN tw ELSE greatest(round_even(w::DOUBLE / h * th, 0), 1) END::BIGINT"
CONTAIN_H = "CASE WHEN w::DOUBLE / h <= tw::DOUBLE / th THEN th ELSE greatest(round_even(h::DOUBLE / w * tw, 0), 1) END::BIGINT"
DECISION = "CASE WHEN (w > h) <> (tw > th) AND mode = 'rotate' AND w <= th AND h <= tw THEN 'rotate' WHEN NOT ((w > h) <> (tw > th) AND w::DOUBLE / h > 1.16::DOUBLE) THEN 'normal' WHEN w::DOUBLE / h >= 1.8::DOUBLE THEN 'rotate' ELSE mode END"


def devices(spark: SparkSession) -> DataFrame:
    """Three screens with their splitter modes; the large Kindle's is the one of its archives."""
    rows = [(c, m, r, profiles.PROFILES[c].width, 1200 if c == "KDX" else profiles.PROFILES[c].height) for c, m, r in DEVICES]
    return F.broadcast(spark.createDataFrame(rows, "code string, mode string, rtl boolean, tw int, th int"))


def on_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).join(devices(spark))


ON_DEVICES = f"(SELECT * FROM ({PAGES_SQL}) CROSS JOIN {DEVICES_SQL}) AS x"


def dims() -> list[Column]:
    return [F.col(c) for c in ("w", "h", "tw", "th")]


@query(f"""
WITH decided AS (SELECT *, {DECISION} AS decision FROM {ON_DEVICES}),
roles AS (SELECT * FROM (VALUES ('normal', 0, 'normal'), ('split', 0, 'split_first'), ('split', 1, 'split_second'), ('rotate', 0, 'rotated'), ('both', 0, 'split_first'), ('both', 1, 'split_second'), ('both', 2, 'rotated')) AS r(decision, piece, role)),
pieces AS (SELECT p_partkey, p_brand, code, tw, th, piece, role,
  CASE WHEN role = 'rotated' THEN h WHEN role = 'normal' OR w <= h THEN w WHEN (role = 'split_second') <> rtl THEN w - w // 2 ELSE w // 2 END AS w,
  CASE WHEN role = 'rotated' THEN w WHEN role = 'normal' OR w > h THEN h WHEN (role = 'split_second') <> rtl THEN h - h // 2 ELSE h // 2 END AS h
  FROM decided JOIN roles USING (decision)),
sized AS (SELECT *, CASE WHEN w <= tw AND h <= th THEN 'keep' WHEN abs(h::DOUBLE / w - th::DOUBLE / tw) < 0.015::DOUBLE OR (code = 'KDX' AND abs(h::DOUBLE / w - th::DOUBLE / tw) < 0.015::DOUBLE * 3.0::DOUBLE) THEN 'fit' WHEN code <> 'KV' THEN 'pad' ELSE 'contain' END AS resize FROM pieces)
SELECT p_brand, p_partkey, code, piece::BIGINT AS piece, role, resize, w::BIGINT AS piece_w, h::BIGINT AS piece_h,
  CASE resize WHEN 'keep' THEN w WHEN 'contain' THEN {CONTAIN_W} ELSE tw END::BIGINT AS out_w,
  CASE resize WHEN 'keep' THEN h WHEN 'contain' THEN {CONTAIN_H} ELSE th END::BIGINT AS out_h,
  row_number() OVER (PARTITION BY p_brand, code ORDER BY p_partkey, piece) AS out_page
FROM sized""")
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page on each device: its pieces, their sizes, how they are resized, and their places in the book."""
    w, h, tw, th = dims()
    decided = on_devices(spark, sf_dir).withColumn("decision", G.decision(w, h, tw, th, F.col("mode")))
    pieces = decided.select("*", F.posexplode(G.roles(F.col("decision"))).alias("piece", "role")).withColumn("s", G.piece_size(w, h, F.col("role"), F.col("rtl")))
    pw, ph = F.col("s.width"), F.col("s.height")
    off = F.lit(False)
    sized = pieces.withColumn("resize", G.resize_mode(pw, ph, tw, th, upscale=off, stretch=off, wallpaper=off, kdx=F.col("code") == "KDX", pads=F.col("code") != "KV"))
    out = G.resized(pw, ph, tw, th, F.col("resize"))
    number = F.row_number().over(Window.partitionBy("p_brand", "code").orderBy("p_partkey", "piece"))
    long = lambda c, n: c.cast("long").alias(n)
    return sized.select("p_brand", "p_partkey", "code", long(F.col("piece"), "piece"), "role", "resize", long(pw, "piece_w"), long(ph, "piece_h"), long(out["width"], "out_w"), long(out["height"], "out_h"), long(number, "out_page"))


#: What each part asks for: a device by its place in the list, a format, and at times a width or a height of its own.
_OWN = ("CASE p_size % 6 WHEN 1 THEN 900 + p_size WHEN 2 THEN 0 WHEN 5 THEN 700 END", "CASE p_size % 6 WHEN 3 THEN 1000 + p_size WHEN 5 THEN 800 END")


@query(f"""
WITH d AS (SELECT *, count(*) OVER () AS n, {FAMILY_SQL} AS family FROM {profiles.sql_values()}),
f AS (SELECT p_partkey, d.*, ['auto', 'epub', 'cbz', 'pdf'][p_partkey // 48 % 4 + 1] AS fmt, {_OWN[0]} AS ow, {_OWN[1]} AS oh FROM part JOIN d ON decl_ord = p_partkey % n),
r AS (SELECT *, CASE WHEN fmt <> 'auto' THEN fmt WHEN family = 'Kindle' THEN 'cbz' WHEN family = 'Remarkable' THEN 'pdf' ELSE 'epub' END AS format, coalesce(ow, 0) <> 0 OR coalesce(oh, 0) <> 0 AS custom FROM f)
SELECT p_partkey, code, family, fmt AS asked, format, custom, coalesce(ow, -1)::BIGINT AS own_w, coalesce(oh, -1)::BIGINT AS own_h,
  CASE WHEN ow IS NULL AND oh IS NULL AND starts_with(code, 'KS') AND format = 'epub' THEN least(width, 1920) ELSE coalesce(ow, width) END::BIGINT AS width,
  CASE WHEN ow IS NULL AND oh IS NULL AND code = 'KDX' AND format = 'cbz' THEN 1200 ELSE coalesce(oh, height) END::BIGINT AS height,
  CASE WHEN custom THEN 16 ELSE gray_levels END::BIGINT AS levels, CASE WHEN NOT custom AND (starts_with(code, 'KS') OR code = 'KCS') THEN 90 ELSE 85 END::BIGINT AS quality FROM r""")
def device_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen, gray levels and quality of the device, format and overrides that each part asks for."""
    known = profiles.dataframe(spark)
    asked = F.element_at(F.array(*map(F.lit, ("auto", "epub", "cbz", "pdf"))), F.expr("cast(p_partkey div 48 % 4 + 1 AS int)"))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(profiles.PROFILES)).alias("_place"), asked.alias("asked"), F.expr(_OWN[0]).cast("int").alias("ow"), F.expr(_OWN[1]).cast("int").alias("oh"))
    code, ow, oh = F.col("code"), F.col("ow"), F.col("oh")
    rows = parts.join(F.broadcast(known), F.col("_place") == F.col("decl_ord"))  # a row for each device of a fixed list
    rows = rows.withColumn("format", F.when(F.col("asked") == "auto", G.automatic_format(code, F.lit(False))).otherwise(F.col("asked")))
    custom = G.is_custom(ow, oh)
    size = G.target_size(code, F.col("width"), F.col("height"), F.col("format"), ow, oh)
    return rows.select("p_partkey", "code", G.family(code).alias("family"), "asked", "format", custom.alias("custom"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(n) for c, n in ((ow, "own_w"), (oh, "own_h"))], size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height"), G.gray_levels(F.col("gray_levels"), custom).cast("long").alias("levels"), G.jpeg_quality(code, custom).cast("long").alias("quality"))


CODES = "concat('K', substring(p_brand, 7), CASE WHEN p_size % 3 = 0 THEN 'S' WHEN p_size % 3 = 1 THEN 'oc' ELSE '' END)"


@query(f"""SELECT p_partkey, code, width::BIGINT AS width, height::BIGINT AS height FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'KV' WHEN p_size % 4 = 1 THEN 'kv' WHEN p_size % 4 = 2 THEN 'KoC' ELSE 'K11' END AS code FROM part) JOIN {profiles.sql_values()} USING (code)""")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices by code, letter case mattering."""
    code = F.when(F.col("p_size") % 4 == 0, "KV").when(F.col("p_size") % 4 == 1, "kv").when(F.col("p_size") % 4 == 2, "KoC").otherwise("K11")
    found = table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).join(F.broadcast(profiles.dataframe(spark)), "code")
    return found.select("p_partkey", "code", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@query(f"""
WITH codes AS (SELECT DISTINCT {CODES} AS asked FROM part),
near AS (SELECT asked, code, levenshtein(lower(asked), lower(code)) AS edits, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(lower(asked), lower(code)), decl_ord) AS place FROM codes CROSS JOIN {profiles.sql_values()})
SELECT asked, edits::BIGINT AS edits, CASE WHEN edits <= greatest(1, greatest(length(asked), 2) // 2) THEN code END AS closest FROM near WHERE place = 1""")
def closest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For codes that are no device: the nearest one by edits, if it is near enough."""
    codes = table(spark, sf_dir, "part").select(F.expr(CODES).alias("asked")).distinct()
    near = codes.join(F.broadcast(profiles.dataframe(spark).select("code", "decl_ord"))).withColumn("edits", F.levenshtein(F.lower("asked"), F.lower("code")))
    best = near.groupBy("asked").agg(F.min(F.struct("edits", "decl_ord", "code")).alias("b"))
    limit = F.greatest(F.lit(1), F.floor(F.greatest(F.length("asked"), F.lit(2)) / 2))
    return best.select("asked", F.col("b.edits").cast("long").alias("edits"), F.when(F.col("b.edits") <= limit, F.col("b.code")).alias("closest"))


@query(f"SELECT p_partkey, code, {DECISION} AS decision FROM {ON_DEVICES}")
def spread_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, tw, th = dims()
    return on_devices(spark, sf_dir).select("p_partkey", "code", G.decision(w, h, tw, th, F.col("mode")).alias("decision"))


@query(f"""SELECT p_partkey, code, (generate_subscripts(r, 1) - 1)::BIGINT AS piece, unnest(r) AS role FROM (SELECT p_partkey, code, CASE decision WHEN 'normal' THEN ['normal'] WHEN 'split' THEN ['split_first', 'split_second'] WHEN 'rotate' THEN ['rotated'] ELSE ['split_first', 'split_second', 'rotated'] END AS r FROM (SELECT *, {DECISION} AS decision FROM {ON_DEVICES}))""")
def spread_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, tw, th = dims()
    decided = on_devices(spark, sf_dir).select("p_partkey", "code", G.decision(w, h, tw, th, F.col("mode")).alias("d"))
    return decided.select("p_partkey", "code", F.posexplode(G.roles(F.col("d"))).alias("piece", "role")).withColumn("piece", F.col("piece").cast("long"))


@query(f"SELECT p_partkey, code, {CONTAIN_W} AS out_w, {CONTAIN_H} AS out_h FROM {ON_DEVICES}")
def contain_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, tw, th = dims()
    s = G.contain(w, h, tw, th)
    return on_devices(spark, sf_dir).select("p_partkey", "code", s["width"].cast("long").alias("out_w"), s["height"].cast("long").alias("out_h"))


@query(f"""SELECT p_partkey, code, variant, CASE WHEN variant = 'stretch' THEN 'stretch' WHEN variant = 'wallpaper' THEN 'fit' WHEN w <= tw AND h <= th AND variant <> 'upscale' THEN 'keep' WHEN abs(h::DOUBLE / w - th::DOUBLE / tw) < 0.015::DOUBLE OR (code = 'KDX' AND abs(h::DOUBLE / w - th::DOUBLE / tw) < 0.015::DOUBLE * 3.0::DOUBLE) THEN 'fit' WHEN code <> 'KV' THEN 'pad' ELSE 'contain' END AS resize, CASE WHEN w <= tw AND h <= th THEN 'bicubic' ELSE 'lanczos' END AS filter FROM {ON_DEVICES} CROSS JOIN (VALUES ('plain'), ('upscale'), ('stretch'), ('wallpaper')) AS v(variant)""")
def resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, tw, th = dims()
    v = F.col("variant")
    rows = on_devices(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, ("plain", "upscale", "stretch", "wallpaper")))).alias("variant"))
    mode = G.resize_mode(w, h, tw, th, upscale=v == "upscale", stretch=v == "stretch", wallpaper=v == "wallpaper", kdx=F.col("code") == "KDX", pads=F.col("code") != "KV")
    return rows.select("p_partkey", "code", "variant", mode.alias("resize"), G.resample_filter(w, h, tw, th).alias("filter"))


_CW, _CH = "CASE WHEN w::DOUBLE / h > tw::DOUBLE / th THEN tw::DOUBLE / th * h ELSE w::DOUBLE END", "CASE WHEN w::DOUBLE / h < tw::DOUBLE / th THEN w / (tw::DOUBLE / th) ELSE h::DOUBLE END"


@query(f"""SELECT p_partkey, code, floor(l * 1024)::BIGINT AS x0, floor(t * 1024)::BIGINT AS y0, floor((l + cw) * 1024)::BIGINT AS x1, floor((t + ch) * 1024)::BIGINT AS y1 FROM (SELECT *, (w - cw) * 0.5::DOUBLE AS l, (h - ch) * 0.5::DOUBLE AS t FROM (SELECT *, {_CW} AS cw, {_CH} AS ch FROM {ON_DEVICES}))""")
def fit_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a page that has the screen's shape, in 1024ths of a pixel."""
    w, h, tw, th = dims()
    b = G.fit_box(w, h, tw, th)
    return on_devices(spark, sf_dir).select("p_partkey", "code", *[F.floor(b[c] * 1024).cast("long").alias(n) for c, n in (("left", "x0"), ("top", "y0"), ("right", "x1"), ("bottom", "y1"))])


@query(f"SELECT p_partkey, code, greatest(round_even(greatest(tw::DOUBLE - cw, 0) * 0.5, 0), 0)::BIGINT AS dx, greatest(round_even(greatest(th::DOUBLE - ch, 0) * 0.5, 0), 0)::BIGINT AS dy FROM (SELECT *, {CONTAIN_W} AS cw, {CONTAIN_H} AS ch FROM {ON_DEVICES})")
def pad_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, tw, th = dims()
    s = G.contain(w, h, tw, th)
    return on_devices(spark, sf_dir).select("p_partkey", "code", G.pad_offset(s["width"], tw).cast("long").alias("dx"), G.pad_offset(s["height"], th).cast("long").alias("dy"))


@query(f"SELECT p_partkey, code, CASE WHEN w > tw * 2 OR h > th THEN {CONTAIN_W.replace('tw', '(tw * 2)')} ELSE w END::BIGINT AS out_w, CASE WHEN w > tw * 2 OR h > th THEN {CONTAIN_H.replace('tw', '(tw * 2)')} ELSE h END::BIGINT AS out_h FROM {ON_DEVICES}")
def upright_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, tw, th = dims()
    s = G.upright(w, h, tw, th)
    return on_devices(spark, sf_dir).select("p_partkey", "code", s["width"].cast("long").alias("out_w"), s["height"].cast("long").alias("out_h"))


_NEAR_W = "th * (w::DOUBLE / h)"
_NEAR_H = "tw / (w::DOUBLE / h)"


@query(f"""SELECT p_partkey, code,
  CASE WHEN tw::DOUBLE / th >= a THEN greatest(CASE WHEN abs(a - ceil(xw) / th) < CASE WHEN floor(xw) = 0 THEN 0 ELSE abs(a - floor(xw) / th) END THEN ceil(xw) ELSE floor(xw) END, 1) ELSE tw END::BIGINT AS out_w,
  CASE WHEN tw::DOUBLE / th >= a THEN th ELSE greatest(CASE WHEN abs(a - tw / ceil(xh)) < CASE WHEN floor(xh) = 0 THEN 0 ELSE abs(a - tw / floor(xh)) END THEN ceil(xh) ELSE floor(xh) END, 1) END::BIGINT AS out_h
FROM (SELECT *, w::DOUBLE / h AS a, {_NEAR_W} AS xw, {_NEAR_H} AS xh FROM {ON_DEVICES}) WHERE NOT (tw >= w AND th >= h)""")
def thumbnail_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of covers that must shrink."""
    w, h, tw, th = dims()
    s = G.thumbnail(w, h, tw, th)
    return on_devices(spark, sf_dir).select("p_partkey", "code", s.alias("s")).where("s IS NOT NULL").select("p_partkey", "code", F.col("s.width").cast("long").alias("out_w"), F.col("s.height").cast("long").alias("out_h"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, (600 + l_partkey % 700)::DOUBLE AS w, (800 + l_suppkey % 900)::DOUBLE AS h, (l_partkey % 200)::DOUBLE AS x0, (l_suppkey % 150)::DOUBLE AS y0, (600 + l_partkey % 700 - (l_orderkey % 220))::DOUBLE AS x1, (800 + l_suppkey % 900 - (l_orderkey % 170))::DOUBLE AS y1, 1 - (l_linenumber * 10)::DOUBLE / 100 AS r FROM lineitem),
c AS (SELECT *, least(0.1::DOUBLE * w, x0) * r AS a0, least(0.1::DOUBLE * h, y0) * r AS b0, greatest(0.9::DOUBLE * w, x1) AS e1, greatest(0.9::DOUBLE * h, y1) AS f1 FROM b),
d AS (SELECT *, e1 + (w - e1) * (1 - r) AS a1, f1 + (h - f1) * (1 - r) AS b1 FROM c)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round_even(a0, 0)::BIGINT AS x0, round_even(b0, 0)::BIGINT AS y0, round_even(a1, 0)::BIGINT AS x1, round_even(b1, 0)::BIGINT AS y1 FROM d WHERE greatest(a1 - a0, 0) * greatest(b1 - b0, 0) / (w * h) >= 0.85::DOUBLE""")
def crop_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes under the policy; those that would leave too little are not applied."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "600 + l_partkey % 700 AS w", "800 + l_suppkey % 900 AS h", "l_partkey % 200 AS x0", "l_suppkey % 150 AS y0", "600 + l_partkey % 700 - l_orderkey % 220 AS x1", "800 + l_suppkey % 900 - l_orderkey % 170 AS y1")
    box = G.crop_policy(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "w", "h")), F.col("l_linenumber") * 10, F.lit(0.85))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), box.alias("b")).where("b IS NOT NULL").select("l_orderkey", "l_linenumber", *[F.col(f"b.{c}").cast("long").alias(n) for c, n in (("left", "x0"), ("top", "y0"), ("right", "x1"), ("bottom", "y1"))])


def _cover_sql() -> str:
    edge = lambda i: "CASE WHEN r > 2.0 THEN {} WHEN r > 1.83::DOUBLE THEN {} WHEN r > 1.7::DOUBLE THEN {} WHEN r > 1.34::DOUBLE THEN {} WHEN r > 1.0 THEN {} ELSE {} END".format(*i)
    pick = lambda a, b: f"CASE WHEN rtl THEN {a} ELSE {b} END"
    left = edge((pick("w / 6.0::DOUBLE", "w / 2.0::DOUBLE + w * 0.02::DOUBLE"), pick("w * 0.19::DOUBLE", "w * 0.425::DOUBLE"), pick("w * 0.2::DOUBLE", "w * 0.417::DOUBLE"), pick("0.0::DOUBLE", "w / 2.0::DOUBLE + w * 0.03::DOUBLE"), pick("w * 0.36::DOUBLE", "0.0::DOUBLE"), "0.0::DOUBLE"))
    right = edge((pick("w / 2.0::DOUBLE - w * 0.02::DOUBLE", "5.0::DOUBLE / 6.0::DOUBLE * w"), pick("w * 0.575::DOUBLE", "0.81::DOUBLE * w"), pick("w * 0.583::DOUBLE", "0.8::DOUBLE * w"), pick("w / 2.0::DOUBLE - w * 0.03::DOUBLE", "w"), pick("w", "0.64::DOUBLE * w"), "w"))
    return f"SELECT p_partkey, rtl, a AS x0, greatest(b - a, 1) AS out_w FROM (SELECT p_partkey, rtl, round_even({left}, 0)::BIGINT AS a, round_even({right}, 0)::BIGINT AS b FROM (SELECT p_partkey, w::DOUBLE AS w, w::DOUBLE / h AS r, rtl FROM ({PAGES_SQL}) CROSS JOIN (VALUES (true), (false)) AS v(rtl)))"


@query(_cover_sql())
def cover_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of wrap-around covers in both reading directions."""
    w, h, _, _ = dims()
    rows = pages(spark, sf_dir).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("rtl"))
    s = G.front_cover(w, h, F.col("rtl"))
    return rows.select("p_partkey", "rtl", s["left"].cast("long").alias("x0"), s["width"].cast("long").alias("out_w"))


@query(f"SELECT p_partkey, code, floor(th::DOUBLE / least(1072, tw) * least(1072, tw, w))::BIGINT AS page_h FROM {ON_DEVICES}")
def virtual_page_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _, tw, th = dims()
    return on_devices(spark, sf_dir).select("p_partkey", "code", G.virtual_page_height(w, tw, th).alias("page_h"))


@query("""
WITH p AS (SELECT doc_id, (doc_id * 7)::BIGINT AS a, (doc_id * 7 + n_chars + 1)::BIGINT AS b, 1000::BIGINT AS ph FROM documents),
q AS (SELECT *, b - a AS n, ceil((b - a)::DOUBLE / ph)::BIGINT AS parts FROM p),
s AS (
  SELECT doc_id, 0 AS i, a AS top, b AS bottom FROM q WHERE n::DOUBLE <= ph * 1.5::DOUBLE
  UNION ALL SELECT doc_id, 0, a, a + ph FROM q WHERE n::DOUBLE > ph * 1.5::DOUBLE
  UNION ALL SELECT doc_id, i, a + i * (n // parts), a + i * (n // parts) + ph FROM (SELECT *, unnest(range(1, parts - 1)) AS i FROM q WHERE n > ph * 2)
  UNION ALL SELECT doc_id, CASE WHEN n <= ph * 2 THEN 1 ELSE parts - 1 END, b - ph, b FROM q WHERE n::DOUBLE > ph * 1.5::DOUBLE)
SELECT doc_id, i::BIGINT AS slice, top, bottom, bottom - top AS height FROM s""")
def tall_panel_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels, as tall as documents are long, cut to pages of 1000."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.tall_slices(F.col("doc_id") * 7, F.col("doc_id") * 7 + F.col("n_chars") + 1, F.lit(1000))).alias("slice", "s"))
    return rows.select("doc_id", F.col("slice").cast("long").alias("slice"), "s.top", "s.bottom", "s.height")
