"""Pages as relations give the same verdicts as pages as packed bytes."""

import numpy as np
import pandas as pd

from folioloom.operators import planes
from folioloom.operators import raster as R


def _pixels(spark, images):
    rows = pd.concat([pd.DataFrame({"image": i, "y": np.repeat(np.arange(len(a)), a.shape[1]), "x": np.tile(np.arange(a.shape[1]), len(a)), "v": a.ravel().astype(np.int64)}) for i, a in enumerate(images)])
    return spark.createDataFrame(rows, "image long, y long, x long, v long")


def test_background(spark):
    rng = np.random.default_rng(0)
    images = [np.full((13, 9), 255), np.full((13, 9), 0), np.full((3, 4), 0), rng.integers(0, 256, (31, 17))]
    for shape, fill in (((20, 30), 0), ((23, 31), 255), ((40, 41), 0), ((41, 22), 255)):
        for inner in (rng.integers(0, 256, (9, 7)), np.full((9, 7), 255 - fill), np.full((1, 1), 255 - fill)):
            a = np.full(shape, fill)
            a[5 : 5 + len(inner), 6 : 6 + inner.shape[1]] = inner
            images.append(a)
    for rows in (slice(0, 5), slice(36, 41), slice(35, 40), slice(3, 9)):  # the boxes are equal and bands decide
        for level in (0, 255):
            a = rng.integers(0, 2, (41, 43)) * 255
            a[rows, 1:-1] = level
            a[[0, -1], 0], a[[0, -1], -1] = 0, 255
            a[0, :2], a[-1, :2], a[0, -2:], a[-1, -2:] = (0, 255), (255, 0), (0, 255), (255, 0)
            images.append(a)
    found = {r.image: r.dark for r in planes.background(_pixels(spark, images)).collect()}
    assert found == {i: R.is_dark(a.astype(np.uint8)) for i, a in enumerate(images)} and len(set(found.values())) == 2


def test_colour(spark):
    rng = np.random.default_rng(1)
    images = [np.repeat(rng.integers(0, 256, (20, 20, 1)), 3, axis=2)]
    for spread in (2, 5, 9, 14, 30, 80):
        gray = rng.integers(60, 200, (40, 40, 1))
        tinted = gray + rng.integers(-spread, spread + 1, (40, 40, 3))
        images += [np.clip(tinted, 0, 255), np.where(rng.random((40, 40, 1)) < 0.01, np.clip(tinted, 0, 255), gray.repeat(3, axis=2)), np.clip(gray + [spread, 0, -spread], 0, 255)]
    rows = []
    for i, a in enumerate(images):
        ycc = R.to_ycbcr(a.astype(np.uint8))
        rows += [(i, c, int(level), int(n)) for c, k in (("cb", 1), ("cr", 2)) for level, n in enumerate(R.histogram(ycc[..., k])) if n]
    found = {r.image: (r.color, r.color_kept) for r in planes.coloured(spark.createDataFrame(rows, "image long, channel string, level long, n long")).collect()}
    assert found == {i: (R.has_color(a.astype(np.uint8)), R.has_color(a.astype(np.uint8), True)) for i, a in enumerate(images)} and len(set(found.values())) >= 3


def test_panels(spark):
    rng = np.random.default_rng(2)
    for width in (320, 470, 60):
        images, rows = [], []
        for i in range(12):
            drawn = rng.random((int(rng.integers(30, 200)), width)) < 0.5
            for _ in range(8):
                y = int(rng.integers(0, len(drawn)))
                drawn[y : y + int(rng.integers(1, 14))] = rng.random() < 0.4
            images.append(drawn)
            inner = drawn[:, width // 20 : width - width // 20]
            rows += [(i, y, bool(not r.any()), bool(r.all())) for y, r in enumerate(inner)]
        found = planes.panels(spark.createDataFrame(rows, "image long, y long, blank boolean, full boolean"), width)
        got = {i: [] for i in range(12)}
        for r in found.orderBy("image", "top").collect():
            got[r.image].append((r.top, r.bottom))
        assert got == {i: R.find_panels(d) for i, d in enumerate(images)}


def test_sizes(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (17, 23)) for _ in range(3)]
    for target in ((50, 9), (7, 40), (23, 60), (23, 17)):
        got = [np.zeros(target[::-1], np.uint8) for _ in images]
        for r in planes.resampled(_pixels(spark, images), 23, 17, *target).collect():
            got[r.image][r.y, r.x] = r.v
        assert all((g == R.resample(a.astype(np.uint8), target, "bicubic")).all() for g, a in zip(got, images, strict=True))


def test_hulls(spark):
    rng = np.random.default_rng(4)
    for n, dx, dy, cell in ((60, 3, 2, 16), (200, 9, 4, 64), (40, 40, 40, 7)):
        at = rng.integers(0, 300, (n, 2))
        boxes = np.stack((at[:, 0], at[:, 0] + rng.integers(0, 9, n), at[:, 1], at[:, 1] + rng.integers(0, 9, n)), axis=1)
        df = spark.createDataFrame([(1, *map(int, b)) for b in boxes] + [(2, *map(int, boxes[0]))] * 2, "image long, left long, right long, top long, bottom long")
        found = planes.hulls(df, dx, dy, cell).collect()
        want = {tuple(map(int, b)) for b in R.merge_near(boxes, dx, dy)}
        assert {tuple(r)[1:] for r in found if r.image == 1} == want and [tuple(r)[1:] for r in found if r.image == 2] == [tuple(map(int, boxes[0]))]
    assert planes.hulls(df.limit(0), 1, 1).count() == 0


def test_hulls_of_crowded_pages(spark, monkeypatch):
    """Boxes that crowd a page are one each square before they meet, boxes get fewer in each round, and hulls are those of all boxes; nulls meet nothing."""
    from folioloom import tables

    counts, store = [], tables.Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(tables.Scratch, "store", counted)
    rng = np.random.default_rng(6)
    at = np.stack((rng.integers(-60, 240, 30_000), rng.integers(-60, 90, 30_000)), axis=1)
    size = rng.integers(0, 30, (30_000, 2))
    far = np.array([[1000 + 39 * i, 1000 + 39 * i + 27, 7 * i, 7 * i + 3] for i in range(60)])  # a chain, each link just near enough
    apart = far + [0, 0, 3000, 3000]
    apart[:, :2] += np.arange(60)[:, None]  # and one with links just too far apart
    crowd = np.stack((at[:, 0], at[:, 0] + size[:, 0], at[:, 1], at[:, 1] + size[:, 1]), axis=1)
    crowd = crowd[(crowd[:, 0] < 60) | (crowd[:, 0] > 130)]
    boxes = np.concatenate((crowd, far, apart))
    rows = [(7, *map(int, b)) for b in boxes] + [(7, None, 5, 1, 2), (None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "image long, left long, right long, top long, bottom long")
    found = planes.hulls(df, 12, 9).collect()
    want = {tuple(map(int, b)) for b in R.merge_near(_by_hand(boxes), 12, 9)}
    assert {tuple(r)[1:] for r in found} == want and len(found) == len(want) and 61 < len(want) < 70
    # The page has room for 330 / 13 by 180 / 10 squares, whatever the number of boxes; each next table is smaller, but for the last.
    assert counts[0] < 900 and all(a > b for a, b in zip(counts[:-2], counts[1:-1], strict=True)) and counts[-1] == counts[-2]


def _by_hand(boxes):
    """The hulls of slices of the boxes, each by the function on bytes: the outcome doesn't depend on the order."""
    return np.concatenate([R.merge_near(x, 12, 9) for x in np.array_split(boxes, 40)])
