"""Natural order: the column, the key inside tasks and a comparison of lists agree."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.functions import natural

NAMES = ["", ".", "..", "...", "a", "A.png", "a.PNG", "a1.png", "a1².png", "a01.png", "a10.png", "a2.png", "a.tar.gz", "a.b.c.png", "a.5.png", "a.longer", ".png", "..a.png", "a..png", "Vol. 1", "1²3", "٣.png",
         "3.png", "１０.png", "a.jpg_x.jpg", "x/a.png", "x.png", "x/y/1.png", "x//1", "/x", "0", "00", "000", "a00b", "ΑΣ.png", "ΑΣ1", "a\n", "a\n1", "a\x00b", "a\x01", "a\x05", "a\x03.p\x02g", "\U0001f10a1", "\U00010d43.png", "9" * 300, "8" * 301, "é" * 90 + "7", "①②", "1①", "a.²x", "$1\\", "İ2"]


def _by_lists(path):
    """The rule by itself: components with their kind, pieces as lists of texts and numbers."""

    def piece(text):
        row, buffer, run = [], "", ""
        for c in [*text.lower(), None]:
            if run and c not in natural.DECIMALS:
                row, buffer, run = [*row, buffer, int(run)], "", ""
            if c in natural.DECIMALS:
                run += natural.DECIMALS[c]
            elif c in natural.ALONE:
                row, buffer = [*row, buffer, int(natural.ALONE[c])], ""
            elif c is not None:
                buffer += c
        return [*row, buffer] if buffer else row

    def name(part):
        stem, found = part, []
        while len(found) < 2 and stem.lstrip(".").rfind(".") > 0:
            at = stem.rfind(".")
            if len(stem) - at > 5 or stem[at + 1 : at + 2] in natural.DECIMALS:
                break
            stem, found = stem[:at], [stem[at:], *found]
        stem = part.replace("".join(found), "") if found else part
        return [piece(p) for p in (stem, *found) if p]

    parts = path.split("/")
    return [(i < len(parts) - 1, name(p)) for i, p in enumerate(parts)]


def test_digits_are_those_of_unicode():
    assert (len(natural.ZEROS), len(natural.SINGLES)) == (76, 21) and list(natural.ZEROS) == sorted(natural.ZEROS)
    for n in range(0x110000):
        c = chr(n)
        if unicodedata.category(c) != "Cn":  # the interpreter's version may be older, never other
            assert natural.DECIMALS.get(c) == (None if (d := unicodedata.decimal(c, None)) is None else str(d))
            if c not in natural.DECIMALS:
                assert natural.ALONE.get(c) == (None if (d := unicodedata.digit(c, None)) is None else str(d))


def _same_order(paths):
    keys, lists = [natural.path_key(p) for p in paths], [_by_lists(p) for p in paths]
    for i in range(len(paths)):
        for j in range(i):
            assert (keys[i] < keys[j], keys[i] == keys[j]) == (lists[i] < lists[j], lists[i] == lists[j]), (paths[i], paths[j])


def test_keys_have_the_order_of_lists():
    _same_order(NAMES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB.019²٣①/ \x00\x01\x02\x03\x04\x05\x06é", max_size=14), min_size=2, max_size=6))
def test_keys_of_any_paths_have_the_order_of_lists(paths):
    _same_order(paths)


def test_the_column_is_the_key_without_a_python_worker(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*NAMES, None])], "id int, path string").repartition(3)
    found = rows.select("id", natural.natural_key("path").alias("key"))
    told = {r.id: r.key for r in found.collect()}
    for i, p in enumerate(NAMES):
        assert bytes(told[i]) == natural.path_key(p), p
    assert told[len(NAMES)] is None
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    ordered = [r.path for r in rows.where("path IS NOT NULL").orderBy(natural.natural_key(F.col("path")), "id").collect()]
    assert ordered == sorted(NAMES, key=lambda p: (_by_lists(p), NAMES.index(p)))
