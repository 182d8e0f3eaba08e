"""Pages as relations of pixels: backgrounds, colour, panels, sizes and boxes by grouping, windows and joins.

The same verdicts as those of `raster`, for pages that are rows (image, y, x, v) rather than packed bytes: a page of any size is
spread over tasks. Tests hold the two to each other.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows or columns of a band; a share of difference, in hundredths, from which boxes decide.
BAND, APART = 5, 0.5
#: Fixed-point ones of weights.
ONE = 22


def background(pixels: DataFrame) -> DataFrame:
    """image and dark: whether the background is dark, by the boxes of light (128 and more) and dark pixels, else by bands of rows and columns."""
    p = pixels.select("image", "y", "x", (F.col("v") >= 128).alias("light"))
    side = lambda light: [f(F.when(F.col("light") == light, F.col(c))) for c in "xy" for f in (F.min, F.max)]
    names = [f"{s}{i}" for s in ("light", "dark") for i in range(4)]
    found = p.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), *[c.alias(n) for c, n in zip(side(True) + side(False), names, strict=True)])
    area = lambda s: ((F.col(f"{s}1") - F.col(f"{s}0") + 1) * (F.col(f"{s}3") - F.col(f"{s}2") + 1)).cast("double")
    light, dark = area("light"), area("dark")
    apart = (F.greatest(light, dark) - F.least(light, dark)) / F.least(light, dark) * 100.0 > APART
    by_boxes = found.select("image", "h", "w", F.when(light.isNotNull() & dark.isNotNull() & apart, dark >= light).alias("by_boxes"))
    score = None
    for at, n in (("y", "h"), ("x", "w")):
        lines = p.groupBy("image", F.col(at).alias("at")).agg(F.count_if("light").alias("light"), F.count(F.lit(1)).alias("n")).join(by_boxes.select("image", F.col(n).alias("size")), "image")
        last = F.ceil(F.col("size") / BAND) - 1
        own = F.floor(F.col("at") / BAND)
        bands = F.array_distinct(F.array_compact(F.array(F.when(own < last, own), F.when(F.col("at") >= F.col("size") - BAND, last))))
        bands = lines.withColumn("band", F.explode(bands)).groupBy("image", "band").agg(F.sum("light").alias("light"), F.sum("n").alias("n"))
        told = bands.select("image", F.when(F.col("light") == 0, 1).when(F.col("light") == F.col("n"), -1).otherwise(0).alias("score"))
        score = told if score is None else score.unionByName(told)
    return by_boxes.join(score.groupBy("image").agg(F.sum("score").alias("score")), "image").select("image", F.coalesce("by_boxes", F.col("score") > 0).alias("dark"))


#: Cuts from either end of the chroma histograms, as shares of the pixels, and the distance from the middle that is colour.
LOOKS = ((lambda n: F.lit(0).cast("long"), 22), (lambda n: F.floor(n * 0.2 / 100.0), 10), (lambda n: F.floor(n * 3 / 100), 4))


def coloured(histograms: DataFrame) -> DataFrame:
    """image, color and color_kept (for pages whose colour is kept) from counts of chroma levels: image, channel, level, n."""
    w = Window.partitionBy("image", "channel")
    h = histograms.withColumn("up", F.sum("n").over(w.orderBy("level"))).withColumn("down", F.sum("n").over(w.orderBy(F.desc("level")))).withColumn("total", F.sum("n").over(w))
    spans = [a for i, (cut, _) in enumerate(LOOKS) for a in (F.min(F.when(F.col("up") > cut(F.col("total")), F.col("level"))).alias(f"low{i}"), F.max(F.when(F.col("down") > cut(F.col("total")), F.col("level"))).alias(f"high{i}"))]
    of_channel = h.groupBy("image", "channel").agg(*spans)
    looks = []
    for i, (_, far) in enumerate(LOOKS):
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        looks += [F.bool_and(high - low < 7).alias(f"narrow{i}"), F.bool_or((low <= 128 - far) | (high >= 128 + far)).alias(f"far{i}"), F.bool_or((low > 128) | (high < 128)).alias(f"aside{i}")]
    found = of_channel.groupBy("image").agg(*looks)
    color = kept = F.lit(False)
    for i in reversed(range(len(LOOKS))):
        color = F.when(F.col(f"narrow{i}"), False).when(F.col(f"far{i}"), True).otherwise(color)
        kept = F.when(F.col(f"aside{i}") | F.col(f"far{i}"), True).otherwise(kept)
    return found.select("image", color.alias("color"), kept.alias("color_kept"))


def panels(rows: DataFrame, width: int) -> DataFrame:
    """image, top and bottom of the panels of strips of a width: rows (image, y, blank, full) say whether all or nothing of a row is drawn between the margins.

    Windows that are all blank or all full are gaps; what lies between two is a panel, but for a short first one.
    """
    window = width // 80 + (width // 80) % 2
    step = max(window // 2, 1)
    image = Window.partitionBy("image")
    frame = image.orderBy("y").rowsBetween(0, window - 1)
    every = lambda c: F.count_if(~F.col(c)).over(frame) == 0 if window else F.lit(True)
    seen = rows.select("image", "y", (F.max("y").over(image) + 1).alias("h"), every("blank").alias("blank"), every("full").alias("full")).where(F.col("y") % step == 0)
    over = F.col("y") + window > F.col("h")
    flat = seen.select("image", "y", "h", (F.col("blank") | ~over & F.col("full")).alias("flat"))
    runs = flat.withColumn("run", F.count_if("flat").over(image.orderBy("y"))).where("NOT flat").groupBy("image", "run").agg(F.min("y").alias("top"), F.max("y").alias("last"), F.first("h").alias("h"))
    to_end = F.col("h") - F.col("last") <= step
    bottom = F.when(to_end, F.col("h")).otherwise(F.col("last") + step)
    short = ~to_end & (F.col("top") < 2 * window) & (bottom - F.col("top") < 2 * window)
    return runs.where(~short).select("image", F.col("top").cast("long").alias("top"), bottom.cast("long").alias("bottom"))


def weights(out: DataFrame, n: int, size: int) -> DataFrame:
    """place, source and weight of bicubic resampling of `n` places to `size`, from a column place: whole numbers of 22 bits. A few rows for each place."""
    scale = n / size
    wide = max(scale, 1.0)
    center = (F.col("place") + 0.5) * F.lit(scale)
    cut = lambda c: F.floor(c).cast("long")  # noqa: E731  # positive: first and last are held to the image
    first = cut(F.greatest(center - 2.0 * wide + 0.5, F.lit(0.0)))
    last = F.least(cut(center + 2.0 * wide + 0.5), F.lit(n))

    def curve(at: Column) -> Column:
        x = F.abs((at.cast("double") - center + 0.5) / F.lit(wide))
        return F.when(x < 1.0, (1.5 * x - 2.5) * x * x + 1.0).when(x < 2.0, (((x - 5.0) * x + 8.0) * x - 4.0) * -0.5).otherwise(0.0)

    places = F.sequence(first, last - 1)
    rows = out.select("place", F.transform(places, lambda at: F.struct(at.alias("source"), curve(at).alias("w"))).alias("ws"))
    rows = rows.withColumn("total", F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"]))
    exact = lambda x: F.when(F.col("total") != 0.0, x["w"] / F.col("total")).otherwise(x["w"]) * float(1 << ONE)
    whole = lambda e: F.when(e < 0, F.ceil(e - 0.5)).otherwise(F.floor(e + 0.5)).cast("long")
    return rows.select("place", F.inline(F.transform("ws", lambda x: F.struct(x["source"].alias("source"), whole(exact(x)).alias("weight")))))


def resampled(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Pixels (image, y, x, v) of images of one size at another: a sparse product across, cut to bytes, and one down."""
    for at, n, size in (("x", width, to_width), ("y", height, to_height)):
        if n == size:
            continue
        told = weights(pixels.sparkSession.range(size).select(F.col("id").alias("place")), n, size)
        other = "y" if at == "x" else "x"
        total = F.shiftright(F.sum(F.col("v") * F.col("weight")) + (1 << (ONE - 1)), ONE)
        pixels = pixels.join(told, F.col(at) == F.col("source")).groupBy("image", other, F.col("place").alias("_to")).agg(F.least(F.greatest(total, F.lit(0)), F.lit(255)).cast("long").alias("v")).select("image", other, F.col("_to").alias(at), "v")
    return pixels.select("image", "y", "x", "v")


def hulls(boxes: DataFrame, dx: int, dy: int, cell: int = 256) -> DataFrame:
    """image and left, right, top, bottom (whole numbers, edges included) of boxes united: boxes at most dx and dy apart become their hull, until no two hulls are near.

    The outcome doesn't depend on the order, so boxes are united wherever that is cheap. Those with a corner or the middle in one square
    of dx + 1 by dy + 1 are near to each other: by such squares a page of any number of boxes comes down to what its area has room for,
    before any box meets another. Then rounds: a box grows to the hull of all that are near to it, found by the cells of a grid that both
    touch, and goes to the one of them with the least hash; what has gone to one box becomes a hull, so boxes get fewer in each
    round in which any two are near. Each round's table is written and read again.
    Boxes with a null meet nothing.
    """
    from folioloom.tables import Scratch

    scratch = Scratch(boxes.sparkSession, "hulls")
    side = ["left", "right", "top", "bottom"]
    hull = lambda at: [(F.min if c in ("left", "top") else F.max)(at(c)).alias(c) for c in side]
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    # A box with sides in the wrong order holds none of its corners.
    odd = F.when((F.col("left") > F.col("right")) | (F.col("top") > F.col("bottom")), F.struct(*side))

    def by_squares(df: DataFrame) -> DataFrame:
        for x, y in ((F.col("left"), F.col("top")), (F.col("right"), F.col("bottom")), (middle("left", "right"), middle("top", "bottom"))):
            squares = df.withColumns({"_x": F.floor(x / (dx + 1)), "_y": F.floor(y / (dy + 1)), "_odd": odd})
            df = squares.groupBy("image", "_x", "_y", "_odd").agg(*hull(F.col), F.sum("n").alias("n")).drop("_x", "_y", "_odd")
        return df

    first = boxes.select("image", *[F.col(c).cast("long").alias(c) for c in side]).dropna().distinct().withColumn("n", F.lit(1).cast("long"))
    now = scratch.store(by_squares(first), "0")
    turn = 0
    while True:
        turn += 1
        span = lambda a, b, more: F.sequence(F.floor((F.col(a) - more) / cell), F.floor((F.col(b) + more) / cell))
        cells = lambda df, mx, my: df.withColumn("_x", F.explode(span("left", "right", mx))).withColumn("_y", F.explode(span("top", "bottom", my)))
        there = cells(now, 0, 0).select("image", "_x", "_y", F.struct(F.xxhash64("image", *side).alias("hash"), *side).alias("to"))
        other = lambda c: F.col(f"to.{c}")
        near = (other("left") - dx <= F.col("right")) & (other("right") + dx >= F.col("left")) & (other("top") - dy <= F.col("bottom")) & (other("bottom") + dy >= F.col("top"))
        met = cells(now, dx, dy).join(there, ["image", "_x", "_y"]).where(near)
        led = met.groupBy("image", *[F.col(c).alias(f"_{c}") for c in side]).agg(F.min("to").alias("_to"), *hull(other))
        grown = led.groupBy("image", "_to").agg(*hull(F.col), F.count(F.lit(1)).alias("n")).drop("_to")
        now = scratch.store(by_squares(grown), str(turn))
        if (now.agg(F.max("n").alias("n")).first()["n"] or 1) == 1:
            return now.drop("n")
