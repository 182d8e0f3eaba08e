"""The divergence audit against plain SQL and plain sums."""

import duckdb
import numpy as np
import pytest

from folioloom.llm import divergence, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, count int, id string, value int"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def _documents():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abÉß漢"), rng.integers(1, 4))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))) + "; It's 5 X-rays\x85", str(rng.choice(["en", "en", "de"])), f"s{rng.integers(0, 40)}") for i in range(700)]
    rows += [(None, None, None, None), (1, "", "", "é"), (1, None, "few", "a"), (2, "words but rare", "few", "b"), (2, "words but rare", "few", "b"), (3, "alone", "one", "z"), (4, " ".join(["long"] * 90_000), "en", None)]
    rows += [(9, "same same", "tie", s) for s in ("b", "a", "Z", "ü") for _ in range(6)]
    return [(*r, 1, "t", 2, "i", 3) for r in rows]


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return sorted(con.sql(registry.SOURCE_DIVERGENCE_SQL).select(", ".join(COLUMNS)).fetchall(), key=str)


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_sql(spark, monkeypatch, block):
    """More sources than a tile holds, one block and many, nulls, ties, languages without kept terms, clashing names."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = _documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sorted(map(tuple, divergence.audit(spark, docs).select(COLUMNS).collect()), key=str)
    assert found == _sql(rows)
    assert ("few", "a", "pair", "b", 0, 1) in found and not any(r[0] == "one" for r in found)


def test_trees_share_nodes_and_equal_plain_sums():
    rng = np.random.default_rng(2)
    for trees, terms in ((1, 1), (5, 37), (9, 256), (4, 300)):
        counts = rng.integers(0, 3, (trees, terms)) * rng.integers(0, 2, (trees, terms))
        counts[0, : terms // 2] = 0
        shared = divergence.Trees(counts)
        wholes = counts.sum(axis=1) + 2 * terms
        a, b = np.triu_indices(trees, 1)
        share = lambda c, w: 1 + 10**9 * (int(c) + 2) // int(w)
        plain = [sum((p - q) ** 2 // (p + q) for p, q in ((share(x, wholes[i]), share(y, wholes[j])) for x, y in zip(counts[i], counts[j], strict=True))) for i, j in zip(a, b, strict=True)]
        assert shared.prices(a, b, wholes[a], wholes[b]).tolist() == plain
    same = divergence.Trees(np.zeros((50, 4096), np.int64))
    assert [len(x) for x in same.levels] == [1] * 13


def test_shares_of_large_counts_are_exact():
    for count, whole in ((10**14, 3 * 10**14 + 7), (0, 9 * 10**15), (5, 7)):
        assert divergence._share(np.array([count]), np.array([whole]))[0] == 1 + 10**9 * (count + 2) // whole


def test_empty_table(spark):
    assert divergence.audit(spark, spark.createDataFrame([], SCHEMA)).count() == 0
