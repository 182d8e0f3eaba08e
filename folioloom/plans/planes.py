"""Queries over pages that are relations of pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import planes

from .base import FOUND, query, table
from .pixels import PIX_SQL, pixels
from .relations import chroma_histograms

#: Images of 64 rows, each with its own shift of levels and a margin that is light, dark or missing.
PAGE_SQL = f"(SELECT vec_id // 64 AS image, vec_id % 64 AS y, x, CASE WHEN (vec_id // 64) % 4 = 0 AND (vec_id % 64 < 7 OR x < 5) THEN 255 WHEN (vec_id // 64) % 4 = 1 AND (vec_id % 64 < 12 OR x < 9) THEN 0 ELSE least(greatest(v + ((vec_id // 64) % 7 - 3) * 40, 0), 255) END AS v FROM {PIX_SQL})"


def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).selectExpr("vec_id div 64 AS image", "vec_id % 64 AS y", "x", "v")
    kind, edge = F.col("image") % 4, lambda rows, columns: (F.col("y") < rows) | (F.col("x") < columns)
    moved = F.least(F.greatest(F.col("v") + (F.col("image") % 7 - 3) * 40, F.lit(0)), F.lit(255))
    return p.withColumn("v", F.when((kind == 0) & edge(7, 5), 255).when((kind == 1) & edge(12, 9), 0).otherwise(moved).cast("long"))


@query(f"""
WITH p AS (SELECT image, y, x, v >= 128 AS light FROM {PAGE_SQL}),
b AS (SELECT image, max(y) + 1 AS h, max(x) + 1 AS w, ((max(x) FILTER (light) - min(x) FILTER (light) + 1) * (max(y) FILTER (light) - min(y) FILTER (light) + 1))::DOUBLE AS light,
  ((max(x) FILTER (NOT light) - min(x) FILTER (NOT light) + 1) * (max(y) FILTER (NOT light) - min(y) FILTER (NOT light) + 1))::DOUBLE AS dark FROM p GROUP BY image),
lines AS (SELECT image, 'y' AS axis, y AS i, h AS n, p.light FROM p JOIN b USING (image) UNION ALL SELECT image, 'x', x, w, p.light FROM p JOIN b USING (image)),
starts AS (SELECT DISTINCT image, axis, unnest(range(0, n, 5)) AS s, n FROM (SELECT image, axis, max(n) AS n FROM lines GROUP BY image, axis)),
bands AS (SELECT s.image, s.axis, s.s, bool_or(l.light) AS any_light, bool_and(l.light) AS all_light FROM starts s JOIN lines l ON l.image = s.image AND l.axis = s.axis AND l.i >= least(s.s, greatest(s.n - 5, 0)) AND l.i < least(s.s, greatest(s.n - 5, 0)) + 5 GROUP BY ALL),
scores AS (SELECT image, sum((NOT any_light)::INT - all_light::INT) AS score FROM bands GROUP BY image)
SELECT image, CASE WHEN light IS NOT NULL AND dark IS NOT NULL AND (greatest(light, dark) - least(light, dark)) / least(light, dark) * 100.0::DOUBLE > 0.5::DOUBLE THEN dark >= light ELSE score > 0 END AS dark FROM b JOIN scores USING (image)""")
def page_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the background of each page is dark."""
    return planes.background(page_pixels(spark, sf_dir))


#: Chroma levels, moved towards the middle so that some images are nearly gray.
CHROMA_SQL = f"(SELECT image, channel, 128 + (level - 128) // (1 + (image % 6) * 8) AS level, sum(n)::BIGINT AS n FROM ({FOUND['chroma_histograms'][1]}) GROUP BY ALL)"


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.lit(128) + F.expr("(level - 128) div (1 + (image % 6) * 8)")
    return chroma_histograms(spark, sf_dir).groupBy("image", "channel", moved.alias("level")).agg(F.sum("n").alias("n"))


@query(f"""
WITH h AS (SELECT *, sum(n) OVER (PARTITION BY image, channel ORDER BY level) AS up, sum(n) OVER (PARTITION BY image, channel ORDER BY level DESC) AS down, sum(n) OVER (PARTITION BY image, channel) AS total FROM {CHROMA_SQL}),
looks AS (SELECT * FROM (VALUES (0, 22), (1, 10), (2, 4)) AS t(look, far)),
cuts AS (SELECT h.*, look, far, CASE look WHEN 0 THEN 0 WHEN 1 THEN floor(total * 0.2::DOUBLE / 100.0::DOUBLE) ELSE floor(total * 3 / 100.0::DOUBLE) END AS cut FROM h CROSS JOIN looks),
spans AS (SELECT image, channel, look, far, min(level) FILTER (up > cut) AS low, max(level) FILTER (down > cut) AS high FROM cuts GROUP BY ALL),
told AS (SELECT image, look, bool_and(high - low < 7) AS narrow, bool_or(low <= 128 - far OR high >= 128 + far) AS away, bool_or(low > 128 OR high < 128) AS aside FROM spans GROUP BY image, look),
first AS (SELECT image, min(look) FILTER (narrow) AS narrow, min(look) FILTER (away) AS away, bool_or(away OR aside) AS kept FROM told GROUP BY image)
SELECT image, coalesce(away, 9) < coalesce(narrow, 9) AS color, kept AS color_kept FROM first""")
def page_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are in colour, from their chroma histograms."""
    return planes.coloured(chroma(spark, sf_dir))


#: Strips of width 320 (each row five times across): what is drawn of a row hangs on a threshold of its own.
_ROWS_SQL = f"(SELECT vec_id // 64 AS image, vec_id % 64 AS y, bool_and(NOT v > 20 + ((vec_id % 64) // 6 * 97 + vec_id // 64 * 31) % 330 - 40) AS blank, bool_and(v > 20 + ((vec_id % 64) // 6 * 97 + vec_id // 64 * 31) % 330 - 40) AS full_ FROM {PIX_SQL} GROUP BY vec_id)"
STRIP = 320


def strip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.col("v") > F.lit(20) + (F.expr("(vec_id % 64) div 6") * 97 + F.expr("vec_id div 64") * 31) % 330 - 40
    return pixels(spark, sf_dir).groupBy("vec_id").agg(F.bool_and(~drawn).alias("blank"), F.bool_and(drawn).alias("full")).selectExpr("vec_id div 64 AS image", "vec_id % 64 AS y", "blank", "full")


@query(f"""
WITH RECURSIVE r AS (SELECT *, max(y) OVER (PARTITION BY image) + 1 AS h FROM {_ROWS_SQL} AS source),
f AS (SELECT a.image, a.y, any_value(a.h) AS h, bool_and(b.blank) OR (a.y + 4 <= any_value(a.h) AND bool_and(b.full_)) AS flat FROM r a JOIN r b ON b.image = a.image AND b.y >= a.y AND b.y < a.y + 4 WHERE a.y % 2 = 0 GROUP BY a.image, a.y),
walk(image, y, top, a, b) AS (SELECT image, -2::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT image FROM f)
  UNION ALL SELECT w.image, f.y, CASE WHEN flat OR h - f.y <= 2 THEN NULL ELSE coalesce(w.top, f.y) END,
    CASE WHEN NOT flat AND h - f.y <= 2 THEN coalesce(w.top, f.y) WHEN flat AND w.top IS NOT NULL AND NOT (w.top < 8 AND f.y - w.top < 8) THEN w.top END,
    CASE WHEN NOT flat AND h - f.y <= 2 THEN h WHEN flat AND w.top IS NOT NULL AND NOT (w.top < 8 AND f.y - w.top < 8) THEN f.y END
  FROM walk w JOIN f ON f.image = w.image AND f.y = w.y + 2)
SELECT image, a AS top, b AS bottom FROM walk WHERE a IS NOT NULL""")
def strip_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of strips: what lies between windows that are all blank or all drawn. The SQL walks from window to window."""
    return planes.panels(strip_rows(spark, sf_dir), STRIP)


def _axis_sql(name: str, n: int, size: int) -> str:
    scale, wide = n / size, max(n / size, 1.0)
    c, s = f"((place + 0.5::DOUBLE) * {scale!r}::DOUBLE)", f"{2.0 * wide!r}::DOUBLE"
    x = f"abs((src::DOUBLE - {c} + 0.5::DOUBLE) / {wide!r}::DOUBLE)"
    return f"""{name}_raw AS (SELECT place, src, CASE WHEN x < 1 THEN (1.5::DOUBLE * x - 2.5::DOUBLE) * x * x + 1.0::DOUBLE WHEN x < 2 THEN (((x - 5.0::DOUBLE) * x + 8.0::DOUBLE) * x - 4.0::DOUBLE) * -0.5::DOUBLE ELSE 0 END AS w
  FROM (SELECT place, src, {x} AS x FROM (SELECT place, unnest(range(floor(greatest({c} - {s} + 0.5::DOUBLE, 0))::BIGINT, least(floor({c} + {s} + 0.5::DOUBLE), {n})::BIGINT)) AS src FROM range({size}) AS r(place)))),
{name}_sum AS (SELECT place, list_reduce(list(w ORDER BY src), lambda a, b: a + b) AS total FROM {name}_raw GROUP BY place),
{name} AS (SELECT place, src, trunc(CASE WHEN e < 0 THEN e - 0.5::DOUBLE ELSE e + 0.5::DOUBLE END)::BIGINT AS weight FROM (SELECT place, src, CASE WHEN total <> 0 THEN w / total ELSE w END * 4194304.0::DOUBLE AS e FROM {name}_raw JOIN {name}_sum USING (place)))"""


#: Widths are enlarged and heights reduced. Rows that the last image lacks count nothing.
TO = (100, 40)


@query(f"""
WITH p AS {PAGE_SQL.replace('(SELECT', 'MATERIALIZED (SELECT', 1)},
size AS (SELECT max(x) + 1 AS w FROM p),
{_axis_sql('across', 64, TO[0])},
{_axis_sql('down', 64, TO[1])},
wide AS (SELECT image, y, place AS x, least(greatest((sum(v * weight)::BIGINT + 2097152) >> 22, 0), 255) AS v FROM p JOIN across ON src = x GROUP BY image, y, place)
SELECT image, place AS y, x, least(greatest((sum(v * weight)::BIGINT + 2097152) >> 22, 0), 255) AS v FROM wide JOIN down ON src = y GROUP BY image, place, x""")
def resample_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page at another size, by bicubic weights in whole numbers."""
    return planes.resampled(page_pixels(spark, sf_dir), 64, 64, *TO)


_LEFT, _TOP = "(p_partkey * 7919 + p_size * p_size * 131) % 900", "(p_partkey * 104729 + p_size * p_size * 977) % 1400"
_BOXES_SQL = f"(SELECT DISTINCT p_brand AS image, {_LEFT} AS l, {_LEFT} + p_size AS r, {_TOP} AS t, {_TOP} + p_size // 2 AS b FROM part)"
NEAR = (12, 9)


@query(f"""
WITH RECURSIVE grow(step, image, l, r, t, b) AS (
  SELECT 0, image, l::BIGINT, r::BIGINT, t::BIGINT, b::BIGINT FROM {_BOXES_SQL}
  UNION ALL SELECT DISTINCT step + 1, image, l, r, t, b FROM (
    SELECT x.step, x.image, min(y.l) AS l, max(y.r) AS r, min(y.t) AS t, max(y.b) AS b FROM grow x JOIN grow y ON x.image = y.image AND y.l - {NEAR[0]} <= x.r AND y.r + {NEAR[0]} >= x.l AND y.t - {NEAR[1]} <= x.b AND y.b + {NEAR[1]} >= x.t
    WHERE x.step < 60 GROUP BY x.step, x.image, x.l, x.r, x.t, x.b))
SELECT image, l AS "left", r AS "right", t AS "top", b AS bottom FROM grow WHERE step = 60""")
def near_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of drawn blobs united while they are near to each other."""
    x, y = F.expr(_LEFT), F.expr(_TOP)
    boxes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("image"), x.alias("left"), (x + F.col("p_size")).alias("right"), y.alias("top"), (y + F.expr("p_size div 2")).alias("bottom"))
    return planes.hulls(boxes, *NEAR)
