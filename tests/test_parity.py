"""Rules that exist as columns and as Python for pixels and bytes: both give the same, on random and on border values."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom import api
from folioloom.functions import geometry as G
from folioloom.functions import text
from folioloom.operators import raster as R
from folioloom.sinks import books

SIZES = [1, 2, 3, 7, 50, 99, 100, 101, 300, 599, 600, 601, 758, 800, 1024, 1072, 1264, 1448, 1680, 1920, 2480, 5000]


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice(SIZES) if rng.random() < 0.5 else rng.randint(1, 4000)
    rows = [(i, pick(), pick(), pick(), pick(), rng.choice(["split", "rotate", "both"]), rng.random() < 0.5) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, w int, h int, tw int, th int, mode string, rtl boolean").cache()


def c(*names):
    return [F.col(n) for n in names]


def test_sizes_and_decisions(sizes):
    out = sizes.select("*", G.contain(*c("w", "h", "tw", "th")).alias("inside"), G.decision(*c("w", "h", "tw", "th", "mode")).alias("decided"), G.thumbnail(*c("w", "h", "tw", "th")).alias("thumb"), G.virtual_page_height(*c("w", "tw", "th")).alias("page"), G.front_cover(*c("w", "h", "rtl")).alias("front"))
    for r in out.collect():
        assert tuple(r.inside) == R.contain_size(r.w, r.h, r.tw, r.th)
        assert r.decided == R.decide(r.w, r.h, r.tw, r.th, r.mode)
        assert (r.thumb and tuple(r.thumb)) == api.thumbnail(r.w, r.h, r.tw, r.th)
        assert r.page == R.virtual_page_height(r.w, r.tw, r.th)
        assert tuple(r.front) == api.front(r.w, r.h, r.rtl)


def test_crop_policy(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        w, h = rng.choice(SIZES), rng.choice(SIZES)
        x, y = sorted(rng.randint(0, w) for _ in range(2)), sorted(rng.randint(0, h) for _ in range(2))
        rows.append((x[0], y[0], x[1], y[1], w, h, rng.choice([0.0, 12.5, 50.0, 100.0, 130.0]), rng.choice([0.0, 0.3, 0.81, 1.0])))
    df = spark.createDataFrame(rows, "l int, t int, r int, b int, w int, h int, preserve double, least double")
    for r in df.select("*", G.crop_policy(*c("l", "t", "r", "b", "w", "h", "preserve", "least")).alias("box")).collect():
        assert (r.box and tuple(r.box)) == R.crop_policy((r.l, r.t, r.r, r.b), r.w, r.h, r.preserve, r.least)


def test_slices_of_tall_panels(spark):
    rng = random.Random(6)
    rows = [(t := rng.randint(0, 900), t + rng.randint(1, 9000), rng.choice([300, 640, 1448, 1680])) for _ in range(1500)]
    for r in spark.createDataFrame(rows, "top long, bottom long, page long").select("*", G.tall_slices(*c("top", "bottom", "page")).alias("s")).collect():
        assert [(p.top, p.bottom) for p in r.s] == R.slice_panels([(r.top, r.bottom)], r.page)


def test_texts(spark):
    names = ["", "7", "-7", "+12", "007", "x", "a<b>&\"c'", "12.5", "é&", "]]>"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    for r in df.select("s", text.zero_fill(F.col("s"), 3).alias("z"), text.xml_escape(F.col("s")).alias("x")).collect():
        assert r.z == api.zero_fill(r.s, 3) and r.x == books.escape(r.s)


def test_bookmarks_after_joins(spark):
    from folioloom.operators import books as B

    rng = random.Random(7)
    labels = {b: sorted({rng.randint(0, 12) for _ in range(rng.randint(0, 6))}) for b in range(60)}
    total = {b: rng.randint(1, 14) for b in labels}
    rows = [(b, p, total[b]) for b, ps in labels.items() for p in ps]
    joined = B.spread_pairs(spark.createDataFrame(rows, "b int, p int, n int"), ["b"], "p", "n").where("outcome = 'joined'")
    marks = spark.createDataFrame([(b, p) for b in labels for p in range(total[b])], "b int, p int")
    for r in B.position_after(marks, joined, ["b"], "p").collect():
        assert r.after == api.position_after(r.p, api.paired(tuple(labels[r.b]))[0], total[r.b])
