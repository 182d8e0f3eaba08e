"""Histograms, boxes, curves and colour on rows of pixels kept as relations; a vector's values stand for a row of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import query, table

VALUE = "least(greatest(floor((v + 0.5::DOUBLE) * 255), 0), 255)::BIGINT"
PIX_SQL = f"(SELECT vec_id, x::BIGINT AS x, {VALUE} AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id (the row), x, v from 0 to 255."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))
    return rows.select("vec_id", F.col("x").cast("long").alias("x"), v.cast("long").alias("v"))


def row_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the row as one array, without a shuffle."""
    v = F.transform("embedding", lambda e: F.least(F.greatest(F.floor((e.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))


@query(f"SELECT v AS level, count(*) AS n FROM {PIX_SQL} GROUP BY v")
def histogram256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy(F.col("v").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id, min(v) AS low, max(v) AS high, max(v) - min(v) < 159 AS left_alone FROM {PIX_SQL} GROUP BY vec_id")
def extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Darkest and lightest value, and whether the span is too small to stretch."""
    r = row_arrays(spark, sf_dir).select("vec_id", F.array_min("v").alias("low"), F.array_max("v").alias("high"))
    return r.withColumn("left_alone", F.col("high") - F.col("low") < 159)


@query(f"SELECT vec_id // 8 AS image, min(x) AS x0, min(vec_id % 8) AS y0, max(x) + 1 AS x1, max(vec_id % 8) + 1 AS y1 FROM {PIX_SQL} WHERE v > 170 GROUP BY vec_id // 8")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of the light pixels of images of 8 rows; images without one are left out."""
    p = pixels(spark, sf_dir).where("v > 170").selectExpr("vec_id div 8 AS image", "x", "vec_id % 8 AS y")
    return p.groupBy("image").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


@query(f"SELECT vec_id, min(v) AS black FROM (SELECT vec_id, v, n, max(n) OVER (PARTITION BY vec_id) AS most FROM (SELECT vec_id, v, count(*) AS n FROM {PIX_SQL} WHERE v < 64 GROUP BY ALL)) WHERE n = most GROUP BY vec_id")
def black_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent of the 64 darkest levels, the first on a tie; rows without dark pixels are left out."""
    p = pixels(spark, sf_dir).where("v < 64").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("vec_id").agg(F.min(F.struct(-F.col("n"), F.col("v").alias("v"))).alias("b")).select("vec_id", F.col("b.v").alias("black"))


@query(f"""WITH m AS (SELECT vec_id % 16 AS image, min(v) AS lo, max(v) AS hi FROM {PIX_SQL} GROUP BY ALL)
SELECT image, l AS level, CASE WHEN hi - lo < 159 THEN l ELSE least(greatest(trunc(l * (255.0::DOUBLE / (hi - lo)) + -lo * (255.0::DOUBLE / (hi - lo))), 0), 255) END::BIGINT AS mapped FROM m CROSS JOIN (SELECT unnest(range(256)) AS l)""")
def autocontrast_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of each image's levels as a table."""
    m = pixels(spark, sf_dir).groupBy((F.col("vec_id") % 16).alias("image")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scale = F.lit(255.0) / (F.col("hi") - F.col("lo"))
    value = F.col("level") * scale + (-F.col("lo")) * scale
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    mapped = F.when(F.col("hi") - F.col("lo") < 159, F.col("level")).otherwise(F.least(F.greatest(whole, F.lit(0)), F.lit(255)))
    return m.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long")))).select("image", "level", mapped.cast("long").alias("mapped"))


@query(f"""WITH h AS (SELECT vec_id % 16 AS image, v, count(*) AS n FROM {PIX_SQL} GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY image ORDER BY v) AS up, sum(n) OVER (PARTITION BY image ORDER BY v DESC) AS down, sum(n) OVER (PARTITION BY image) AS total FROM h)
SELECT image, min(v) FILTER (up > total // 100) AS low, max(v) FILTER (down > total // 100) AS high FROM c GROUP BY image""")
def cutoff_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels still occupied once a hundredth of the pixels is taken from either end."""
    h = pixels(spark, sf_dir).groupBy((F.col("vec_id") % 16).alias("image"), "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image")
    c = h.withColumn("up", F.sum("n").over(w.orderBy("v"))).withColumn("down", F.sum("n").over(w.orderBy(F.col("v").desc()))).withColumn("cut", F.floor(F.sum("n").over(w) / 100))
    return c.groupBy("image").agg(F.min(F.when(F.col("up") > F.col("cut"), F.col("v"))).alias("low"), F.max(F.when(F.col("down") > F.col("cut"), F.col("v"))).alias("high"))


_EXPONENTS = ("0.5", "1.8", "2.2")


@query(f"SELECT vec_id % 16 AS image, g, v, count(*) AS n, trunc(255 * pow(v / 255.0::DOUBLE, g::DOUBLE))::BIGINT AS mapped FROM (SELECT vec_id, v, ['0.5', '1.8', '2.2'][vec_id % 3 + 1] AS g FROM {PIX_SQL}) GROUP BY ALL")
def gamma_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of 16 images by gamma tables, of which the exponent is a decimal text; every row of pixels has one of three."""
    g = F.element_at(F.array(*map(F.lit, _EXPONENTS)), (F.col("vec_id") % 3 + 1).cast("int"))
    counted = pixels(spark, sf_dir).groupBy((F.col("vec_id") % 16).alias("image"), g.alias("g"), "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("mapped", F.floor(255 * F.pow(F.col("v") / 255.0, F.col("g").cast("double"))).cast("long"))


@query(f"SELECT vec_id, count(*) FILTER (v <= 240 - 64 * 1.0) AS foreground, count(*) AS total FROM {PIX_SQL} GROUP BY vec_id")
def threshold_fg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = row_arrays(spark, sf_dir)
    return r.select("vec_id", F.size(F.filter("v", lambda p: p <= F.lit(240 - 64 * 1.0))).cast("long").alias("foreground"), F.size("v").cast("long").alias("total"))


_RGB = f"(SELECT a.vec_id, a.x // 3 AS pixel, a.v AS r, b.v AS g, c.v AS b FROM {PIX_SQL} a JOIN {PIX_SQL} b ON a.vec_id = b.vec_id AND b.x = a.x + 1 JOIN {PIX_SQL} c ON a.vec_id = c.vec_id AND c.x = a.x + 2 WHERE a.x % 3 = 0)"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, pixel and r, g, b of successive values, without a join."""
    cells = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("pixel"), *[F.element_at("v", i * 3 + k + 1).alias(n) for k, n in enumerate("rgb")]))
    return row_arrays(spark, sf_dir).select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")


@query(f"SELECT vec_id, pixel, (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 AS gray FROM {_RGB}")
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb(spark, sf_dir).select("vec_id", "pixel", F.shiftright(19595 * F.col("r") + 38470 * F.col("g") + 7471 * F.col("b") + 32768, 16).alias("gray"))


# Coefficients of the two chroma channels.
CB, CR = (-0.16874, -0.33126, 0.5), (0.5, -0.41869, -0.08131)


@query("SELECT vec_id, pixel, " + ", ".join(f"least(greatest(floor(({' + '.join(f'trunc({k}::DOUBLE * 64 * {c} + 0.5::DOUBLE)' for k, c in zip(row, 'rgb', strict=True))}) / 64) + 128, 0), 255)::BIGINT AS {n}" for n, row in (("cb", CB), ("cr", CR))) + f" FROM {_RGB}")
def ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma by whole-number tables: each term is cut to a whole, the sum shifted by six bits."""

    def chroma(row):
        def term(k: float, c: str):
            x = F.lit(k) * 64 * F.col(c) + 0.5
            return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))

        total = sum((term(k, c) for k, c in zip(row[1:], "gb", strict=True)), term(row[0], "r"))
        return F.least(F.greatest(F.floor(total / 64) + 128, F.lit(0)), F.lit(255)).cast("long")

    return rgb(spark, sf_dir).select("vec_id", "pixel", chroma(CB).alias("cb"), chroma(CR).alias("cr"))


@query(f"SELECT vec_id, x, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v) + 1) // 3 AS blurred FROM {PIX_SQL} WINDOW w AS (PARTITION BY vec_id ORDER BY x)")
def box_blur_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three with repeated edges, rounded; a sum of three never lies half way."""
    at = lambda i: F.element_at("v", F.least(F.greatest(i, F.lit(0)), F.size("v") - 1) + 1)
    cells = F.transform("v", lambda v, i: F.struct(i.cast("long").alias("x"), F.floor((at(i - 1) + v + at(i + 1) + 1) / 3).cast("long").alias("blurred")))
    return row_arrays(spark, sf_dir).select("vec_id", F.explode(cells).alias("c")).select("vec_id", "c.*")


EDGE_SQL = f"""WITH p AS (SELECT vec_id // 8 AS image, vec_id % 8 AS y, x, v, sum(v) OVER (PARTITION BY vec_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS three FROM {PIX_SQL}),
s AS (SELECT *, sum(three) OVER (PARTITION BY image, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around, max(y) OVER (PARTITION BY image) AS bottom, max(x) OVER (PARTITION BY image, y) AS last FROM p)
SELECT image, y, x, (CASE WHEN y = 0 OR x = 0 OR x = last OR y = bottom THEN v ELSE 9 * v - around END > 6)::BIGINT AS drawn FROM s"""


@query(EDGE_SQL)
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that differ from their eight neighbours, borders by their own value, on all images of 8 rows; a missing row counts as 0."""
    rows = row_arrays(spark, sf_dir).selectExpr("vec_id div 8 AS image", "vec_id % 8 AS y", "v")
    w = Window.partitionBy("image").orderBy("y")
    beside = lambda f, y: F.when(f("y").over(w) == y, f("v").over(w))
    rows = rows.withColumn("up", beside(F.lag, F.col("y") - 1)).withColumn("down", beside(F.lead, F.col("y") + 1)).withColumn("edge", (F.col("y") == 0) | F.lead("y").over(w).isNull())
    three = lambda c, i: F.element_at(c, i) + F.element_at(c, i + 1) + F.element_at(c, i + 2)
    other = lambda c, i: F.coalesce(three(c, i), F.lit(0))
    inner = lambda v, i: 9 * v - other("up", i) - three("v", i) - other("down", i)
    border = lambda i: F.col("edge") | (i == 0) | (i == F.size("v") - 1)
    cells = F.transform("v", lambda v, i: F.struct(i.cast("long").alias("x"), (F.when(border(i), v).otherwise(inner(v, i)) > 6).cast("long").alias("drawn")))
    return rows.select("image", "y", F.explode(cells).alias("c")).select("image", "y", "c.*")


@query(EDGE_SQL)
def edge_filter_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`edge_filter` under its other name."""
    return edge_filter(spark, sf_dir)
