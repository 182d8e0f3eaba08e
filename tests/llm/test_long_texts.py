"""Texts beyond every slice that operators read at a time: 4 MiB of words, 2^19 and 2^21 bytes of q-grams."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioloom.llm import bm25, html_text, language, near_dups, repeats, words

LONG = 5_200_000


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5_000)])
    return " ".join(rng.choice(vocabulary, n // 7 + 1))[:n]


@pytest.fixture(scope="module")
def long_docs(spark):
    base = _prose(1, LONG)
    near = base.split(" ")
    near[100:40_000:400] = ["changed"] * len(near[100:40_000:400])
    rows = [(1, base), (2, " ".join(near)), (3, _prose(2, LONG)), (20, base[:3000]), (4, None), (5, "short text")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (3, 5_000_000, 0, 2_000_000, 3_000_000, 1)] + [None])
    cuts = words.slices(texts)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and len(cuts) > 2


def test_grams_and_runs_are_the_same_in_slices():
    """Identifiers equal those of the bytes alone, and a choice doesn't depend on where a slice begins."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, (1 << 21) + 70_000).astype(np.uint8)
    ids = repeats.gram_ids(data, 64)
    for at in [0, (1 << 19) - 40, (1 << 19) - 1, 1 << 19, (1 << 20) + 5, (1 << 21) - 3, len(data) - 64]:
        assert ids[at] == repeats.gram_ids(data[at : at + 64], 64)[0]
    gram, place, first, last = repeats._runs(data, 200, 64)
    assert first[0] == 0 and last[-1] == len(data) - 200 and np.array_equal(first[1:], last[:-1] + 1)
    for start in [5, (1 << 21) - 150, (1 << 21) - 1, 1 << 21, (1 << 21) + 9]:
        i = int(np.searchsorted(first, start, side="right")) - 1
        own = repeats._runs(data[start : start + 200], 200, 64)
        assert own[0][0] == gram[i] and own[1][0] + start == place[i]


def test_repeats_over_the_cuts(spark):
    """A passage that lies over a cut of a long text and again in another one, and nothing else, is removed."""
    passage = _prose(9, 460)
    one, two = _prose(10, (1 << 21) + 9_000), _prose(11, 9_000)
    for cut in (1 << 19, 1 << 21):
        one = one[: cut - 230] + passage + one[cut - 230 + len(passage) :]
    two = two[:500] + passage + two[500 + len(passage) :]
    got = {r.doc_id: r for r in repeats.spans(spark, spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()}
    # What lies beside the passage is the same by chance for some bytes at most.
    assert got[1].n_spans == 2 and got[2].n_spans == 1
    left = two.replace(passage, "", 1)
    assert abs(got[2].n_removed - len(passage)) <= 8 and (got[2].n_removed != len(passage) or got[2].kept_sha256 == hashlib.sha256(left.encode()).hexdigest())
    assert abs(got[1].n_removed - 2 * len(passage)) <= 16


def test_long_near_duplicates(spark, long_docs):
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dups.cluster(spark, long_docs[1], k=3, percent=85).collect()}
    assert {d: c for d, (c, _) in got.items()} == {1: 1, 2: 1, 3: 3, 20: 20, 4: 4, 5: 5}
    w = long_docs[0][2][1].split()
    assert got[3][1] == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def test_long_texts_are_searched(spark, long_docs):
    rows = [(d, Counter(t.split())) for d, t in long_docs[0] if t]
    mean, df = sum(sum(c.values()) for _, c in rows) / len(rows), Counter(w for _, c in rows for w in c)
    score = lambda c: sum(math.log1p((len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in dict(rows)[20] if w in c)
    want = sorted(((-round(score(c), 9), d) for d, c in rows if score(c) > 0))[:3]
    got = bm25.search(spark, long_docs[1], long_docs[1].where("doc_id = 20"), k=3).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(d, round(-s, 6)) for s, d in want]


def test_long_pages_and_languages():
    page = "<div>top</div>" + "".join(f"<p>line {i}</p>" for i in range(120_000)) + "<div>end</div>"
    other = "<div>top</div>" + "".join(f"<p>row {i}</p>" for i in range(120_000)) + "<div>end</div>"
    text = html_text.text_of(html_text.lines(page), [t for t, _ in html_text.lines(other)])
    assert text.startswith("line 0\nline 1\n") and text.endswith("line 119999") and len(page) > 2_000_000
    counts = {x: Counter(np.unique(language.grams(_prose(s, 20_000))).tolist() * 2) for x, s in (("a", 1), ("b", 77))}
    model = language.build(counts, {"a": 2, "b": 2})
    assert language.predict(model, _prose(1, LONG))[0] == "a"
