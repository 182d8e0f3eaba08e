"""Raster rules against slow, plain statements of them, and codecs by round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom import profiles
from folioloom.operators import raster as R
from folioloom.operators.pages import PageOptions, process
from folioloom.sinks import images as out
from folioloom.sources import images as source


@pytest.fixture(scope="module")
def gray():
    rng = np.random.default_rng(0)
    return np.clip(128 + np.cumsum(rng.integers(-9, 10, (120, 90)), axis=1), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def color(gray):
    return np.stack((gray, np.roll(gray, 3, 0), 255 - gray), -1)


@pytest.mark.parametrize("levels", list(profiles.PALETTES.values()))
def test_dither_pixel_by_pixel(gray, levels):
    src = gray[:40, :31].astype(int)
    cut = lambda v: abs(v) // 16 * (1 if v >= 0 else -1)
    errors, want = {}, np.zeros(src.shape, int)
    h, w = src.shape
    for y in range(h):
        for x in range(w):
            at = lambda dy, dx: errors.get((y + dy, x + dx), (0, 0, 0))  # noqa: B023, E731
            owed = [3 * a + 5 * b + c for a, b, c in zip(at(-1, 1), at(-1, 0), at(-1, -1), strict=True)]
            if x == w - 1 and y:
                last, before = at(-1, 0)[2], at(-1, -1)[2]
                owed = [5 * last + before, last, last]
            work = [min(255, max(0, src[y, x] + cut(7 * e + o))) for e, o in zip(at(0, -1), owed, strict=True)]
            i = min(range(len(levels)), key=lambda i: (sum((v // 4 * 4 - levels[i]) ** 2 for v in work), i))  # noqa: B023
            want[y, x] = i
            errors[y, x] = tuple(v - levels[i] for v in work)
    assert (R.dither(src.astype(np.uint8), levels) == want).all()


def test_known_sizes_and_tables():
    assert R.contain_size(720, 1280, 1072, 1448) == (814, 1448)
    assert R.contain_size(608, 741, 1072, 1448) == (1072, 1306)
    assert R.contain_size(510, 1632, 1072, 1448) == (452, 1448)
    levels = np.array([0, 1, 64, 128, 200, 254, 255], np.uint8)
    assert R.gamma(levels, "1.8").tolist() == [0, 0, 21, 73, 164, 253, 255]
    assert R.gamma(levels, "0.5").tolist() == [0, 15, 127, 180, 225, 254, 255]
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [200, 100, 50]]], np.uint8)
    assert R.to_gray(rgb).tolist() == [[76, 150, 29, 124]]
    assert R.crop_policy((60, 90, 140, 210), 200, 300) == (20, 30, 180, 270)
    assert R.crop_policy((300, 300, 600, 600), 905, 1005) == (90, 100, 814, 904)
    assert R.close_groups(np.array([1, 2, 3, 100, 101]), 5) == [(1, 3), (101, 101)]
    assert R.virtual_page_height(800, 1072, 1448) == 1080 and R.virtual_page_height(800, 1264, 1680) == 1253
    assert [a for a, _ in R.slice_panels([(100, 3600)], 1000)] == [100, 975, 1850, 2600]
    assert R.slice_panels([(100, 1900)], 1000) == [(100, 1100), (900, 1900)]


def test_decisions():
    on = lambda w, h, mode: R.decide(w, h, 1072, 1448, mode)
    assert [on(1200, 1100, "split"), on(2000, 1448, "split"), on(3000, 1448, "split"), on(1000, 900, "rotate"), on(1500, 1400, "rotate")] == ["normal", "split", "rotate", "rotate", "normal"]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 50), st.integers(1, 50), st.sampled_from(["bicubic", "lanczos"]))
def test_resample_of_a_flat_page_is_flat(w, h, tw, th, name):
    assert (R.resample(np.full((h, w), 77, np.uint8), (tw, th), name) == 77).all()


def test_resample_against_a_loop(gray):
    a = gray[:20, :17]
    import math

    def one(row, n):
        scale = len(row) / n
        wide = max(scale, 1.0)
        result = []
        for i in range(n):
            c = (i + 0.5) * scale
            lo, hi = max(0, int(c - 3 * wide + 0.5)), min(len(row), int(c + 3 * wide + 0.5))
            sinc = lambda v: 1.0 if v == 0 else math.sin(v * math.pi) / (v * math.pi)
            ks = [sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0 for x in ((j - c + 0.5) / wide for j in range(lo, hi))]
            fixed = [int(k / sum(ks) * (1 << 22) + (0.5 if k >= 0 else -0.5)) for k in ks]
            result.append(min(255, max(0, ((1 << 21) + sum(int(row[lo + j]) * f for j, f in enumerate(fixed))) >> 22)))
        return result

    across = np.array([one(r, 11) for r in a])
    want = np.array([one(c, 13) for c in across.T]).T
    assert (R.resample(a, (11, 13), "lanczos") == want).all()


def test_background_and_color(gray, color):
    page = np.full((100, 80), 255, np.uint8)
    page[30:60, 20:60] = 0
    assert not R.is_dark(page) and R.is_dark(255 - page)
    assert not R.has_color(R.to_rgb(gray)) and R.has_color(color)
    back = R.from_ycbcr(R.to_ycbcr(color)).astype(int)
    assert np.abs(back - color).max() <= 4


def test_content_box_drops_a_page_number():
    page = np.full((1000, 700), 255, np.uint8)
    page[100:880, 80:620] = 0
    page[940:955, 340:352] = 0
    whole, bare = (R.content_box(page, 1.0, False, n) for n in (False, True))
    assert whole[3] > 950 and bare[3] < 890


def test_gutters():
    page = np.full((1000, 400), 255, np.uint8)
    page[50:400, 20:380] = 0
    page[600:950, 20:380] = 0
    cut = R.cut_gutters(page, page, False, False)
    assert cut.shape[1] == 400 and 800 < cut.shape[0] < 830


def test_strip_is_cut_between_panels():
    strip = np.full((3000, 800, 3), 255, np.uint8)
    for top in (100, 1100, 2100):
        strip[top : top + 800, 100:700] = np.random.default_rng(top).integers(0, 255, (800, 600, 1))
    cut = R.split_strip(strip, 1072, 1448)
    assert len(cut) == 3 and all(780 < len(p) < 900 for p in cut)
    assert R.split_strip(np.full((3000, 800, 3), 255, np.uint8), 1072, 1448) == []


def test_png_forms(gray, color):
    assert (source.decode(out.png(gray)).pixels == gray).all() and source.decode(out.png(gray)).single
    assert (source.decode(out.png(color)).pixels == color).all()
    index = R.dither(gray, profiles.PALETTES[4])
    assert (source.decode(out.indexed_png(index, profiles.PALETTES[4])).pixels[..., 0] == np.array(profiles.PALETTES[4])[index]).all()
    data = out.png(color)
    half = source.decode(data[: len(data) // 2])
    assert half.truncated and (half.pixels[:20] == color[:20]).all() and not half.pixels[-1].any()
    with pytest.raises(source.ImageError):
        source.decode(b"RIFF0000WEBPVP8 ")


def test_gif_and_bmp():
    gif = bytes.fromhex("47494638396102000200800000ff000000ff002c00000000020002000002028451003b")
    assert source.dimensions(gif) == (2, 2)
    assert source.decode(gif).pixels.shape == (2, 2, 3)
    body = bytes([0, 0, 255, 0, 255, 0, 0, 0])
    bmp = b"BM" + (54 + 8).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\x01\0\x18\0" + bytes(24) + body
    assert source.decode(bmp).pixels.tolist() == [[[255, 0, 0], [0, 255, 0]]]


def test_jpeg_is_read_back_by_the_jvm(spark, tmp_path, gray, color):
    (tmp_path / "g.jpg").write_bytes(out.jpeg(gray, 95))
    (tmp_path / "c.jpg").write_bytes(out.jpeg(np.repeat(np.repeat(color[::8, ::8], 8, 0), 8, 1), 95))
    assert source.dimensions(out.jpeg(gray, 95)) == (90, 120)
    rows = {r.rel_path.rsplit("/", 1)[-1]: r for r in source.jpeg_rasters(spark, str(tmp_path)).collect()}
    back = np.frombuffer(rows["g.jpg"].data, np.uint8).reshape(120, 90, -1)[..., 0]
    assert np.abs(back.astype(int) - gray).mean() < 2
    assert (rows["c.jpg"].width, rows["c.jpg"].channels) == (96, 3)


def test_jpeg_decoder_agrees_with_the_jvm(spark, tmp_path, gray, color):
    smooth = np.repeat(np.repeat(color[::8, ::8], 8, 0), 8, 1)[:101, :93]
    forms = {"g": gray, "c": smooth, "small": gray[:5, :3]}
    for name, a in forms.items():
        (tmp_path / f"{name}.jpg").write_bytes(out.jpeg(a, 90))
    for r in source.jpeg_rasters(spark, str(tmp_path)).collect():
        a = forms[r.rel_path.rsplit("/", 1)[-1][:-4]]
        own = source.decode((tmp_path / r.rel_path.rsplit("/", 1)[-1]).read_bytes()).pixels
        jvm = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
        assert own.shape[:2] == a.shape[:2] == jvm.shape[:2]
        assert np.abs(own.reshape(jvm.shape).astype(int) - jvm).mean() < 1.0
        assert np.abs(own.astype(int) - a).mean() < 6
    with pytest.raises(source.ImageError):
        source.decode(out.jpeg(gray, 90)[:-400])


def test_page_pieces(gray):
    spread = np.tile(np.pad(gray, 30, constant_values=255), (1, 2))
    both = PageOptions(splitter="both", format="epub", right_to_left=True)
    assert [r for r, *_ in process(spread, True, False, both)] == ["split_first", "split_second", "rotated"]
    first = PageOptions(splitter="both", format="epub", rotate_first=True)
    assert [r for r, *_ in process(spread, True, False, first)] == ["rotated", "split_first", "split_second"]
    page = process(gray, True, False, PageOptions(format="cbz", upscale=True, force_png=True))[0]
    assert page[2].shape == (1448, 1072) and set(np.unique(page[2])) <= set(profiles.PALETTES[16])


def test_edge_filter_takes_every_image(spark, tmp_path):
    """Against brute force on 11 images, one without its third row, the last cut off."""
    from folioloom.plans import pixels

    rng = np.random.default_rng(8)
    ids = [i for i in range(85) if i != 18]
    vectors = rng.normal(size=(len(ids), 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    value = {r.vec_id: list(r.v) for r in pixels.row_arrays(spark, str(tmp_path)).collect()}
    want = {}
    for i in ids:
        bottom = max(j % 8 for j in ids if j // 8 == i // 8)
        for x in range(64):
            around = sum(value[j][k] for j in (i - 1, i, i + 1) if j in value and j // 8 == i // 8 for k in (x - 1, x, x + 1) if 0 <= k < 64)
            edge = i % 8 in (0, bottom) or x in (0, 63)
            want[i // 8, i % 8, x] = int((value[i][x] if edge else 9 * value[i][x] - around) > 6)
    assert {(r.image, r.y, r.x): r.drawn for r in pixels.edge_filter_whole(spark, str(tmp_path)).collect()} == want


def test_merge_near_against_one_pair_at_a_time():
    """Hulls as by uniting any two near boxes, over and over."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        left, top = rng.integers(0, 60, 8), rng.integers(0, 20, 8)
        boxes = [tuple(map(float, b)) for b in zip(left, left + rng.integers(0, 12, 8), top, top, strict=True)]
        want = list(boxes)
        while pair := next(((a, b) for i, a in enumerate(want) for b in want[:i] if max(a[0] - b[1], b[0] - a[1]) <= 3 and max(a[2] - b[3], b[2] - a[3]) <= 2), None):
            a, b = pair
            want.remove(a)
            want.remove(b)
            want.append((min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])))
        assert sorted(map(tuple, R.merge_near(np.array(boxes), 3, 2).tolist())) == sorted(want)
    assert R.merge_near(np.zeros((0, 4)), 1, 1).shape == (0, 4)


def _by_the_jvm(spark, a, progressive):
    """A JPEG of the JVM's writer, which sends refinements of bits when it is progressive."""
    jvm = spark._jvm
    h, w = a.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if a.ndim == 2 else 1)
    if a.ndim == 2:
        for y in range(h):
            for x in range(w):
                image.getRaster().setSample(x, y, 0, int(a[y, x]))
    else:
        for y in range(h):
            for x in range(w):
                image.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)  # MODE_DEFAULT
    body = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(body)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(body.toByteArray())


@pytest.mark.parametrize("shape", [(37, 45), (33, 50, 3)])
def test_progressive_jpegs_have_the_pixels_of_sequential_ones(spark, shape):
    rng = np.random.default_rng(5)
    a = (rng.integers(0, 256, shape) // 2 + np.linspace(0, 120, shape[1]).reshape((1, -1) + (1,) * (len(shape) - 2))).astype(np.uint8)
    plain, steps = _by_the_jvm(spark, a, False), _by_the_jvm(spark, a, True)
    assert b"\xff\xc2" in steps and steps.count(b"\xff\xda") > 3
    one, two = source.decode(plain).pixels, source.decode(steps).pixels
    assert one.shape == shape and np.array_equal(one, two)
    # A file that ends after some of its scans is the coarser image that these hold.
    cut = steps[: steps.rindex(b"\xff\xda")]
    assert np.abs(source.decode(cut).pixels.astype(int) - two).mean() < 20


def test_jpegs_of_four_components():
    """Adobe's inverted inks: each colour as far as black leaves it."""
    gray = out.jpeg(np.full((16, 16), 200, np.uint8), 100)
    at = gray.index(b"\xff\xc0")
    n = int.from_bytes(gray[at + 2 : at + 4], "big")
    scan = gray.index(b"\xff\xda")
    body = gray[scan + 2 + int.from_bytes(gray[scan + 2 : scan + 4], "big") : -2]
    frame = b"\xff\xc0" + (8 + 12).to_bytes(2, "big") + gray[at + 4 : at + 9] + b"\x04" + b"".join(bytes([i, 0x11, 0]) for i in range(1, 5))
    scans = b"".join(b"\xff\xda\x00\x08\x01" + bytes([i]) + b"\x00\x00\x3f\x00" + body for i in range(1, 5))
    adobe = b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00\x00"
    data = gray[:2] + adobe + gray[2:at] + frame + gray[at + 2 + n : scan] + scans + b"\xff\xd9"
    pixels = source.decode(data).pixels
    assert pixels.shape == (16, 16, 3) and np.abs(pixels.astype(int) - round(200 * 200 / 255)).max() <= 1


def test_recoded_jpegs_are_smaller_and_the_same(spark):
    from folioloom.sinks.recode import recode

    rng = np.random.default_rng(9)
    for shape in ((70, 90), (64, 50, 3)):
        a = (rng.integers(0, 60, shape) + np.linspace(0, 190, shape[1]).reshape((1, -1) + (1,) * (len(shape) - 2))).astype(np.uint8)
        plain, steps = _by_the_jvm(spark, a, False), _by_the_jvm(spark, a, True)
        made = recode(plain)
        assert len(made) < len(plain) and np.array_equal(source.decode(made).pixels, source.decode(plain).pixels)
        assert recode(made) == made and recode(steps) == steps and recode(b"\xff\xd8\xff") == b"\xff\xd8\xff"


@pytest.mark.parametrize("shape", [(61, 83), (64, 48, 3), (45, 33, 3)])
def test_jpeg_pixels_equal_the_jvms(spark, shape):
    """The JVM decodes with the same transform in whole numbers, and with the same smooth upsampling of chroma."""
    rng = np.random.default_rng(11)
    a = (rng.integers(0, 256, shape) // 2 + np.linspace(0, 120, shape[1]).reshape((1, -1) + (1,) * (len(shape) - 2))).astype(np.uint8)
    data = _by_the_jvm(spark, a, False)
    jvm = spark._jvm
    raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster()
    bands = 1 if a.ndim == 2 else 3
    flat = np.array(list(raster.getPixels(0, 0, a.shape[1], a.shape[0], spark.sparkContext._gateway.new_array(jvm.int, a.size))), int)
    want = flat.reshape(a.shape[0], a.shape[1], bands)
    got = source.decode(data).pixels.reshape(want.shape)
    assert np.array_equal(got, want)
