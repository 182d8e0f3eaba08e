"""Nearest neighbours, page text, language identification and the pipeline."""

import zlib

import numpy as np
import pytest

from folioloom.llm import html_text, language, neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:140] = x[100]
    vectors = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    vectors += [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [float("nan")] + [1.0] * 15, "x"), (1003, [None] + [1.0] * 15, "x"), (1004, [1.0] * 3, "x"), (None, [1.0] * 16, "x"), (1050, [float("inf")] + [1.0] * 15, "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, vector string").repartition(3)
    got = {}
    for r in neighbours.nearest(spark, df, query_mod=50, k=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 400, 50))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        order = [i for i in np.lexsort((np.arange(400), -np.round(s, 12))) if i != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(score - s[i]) < 1e-9 for i, score in found.values())
        hits += len({i for i, _ in found.values()} & set(order))
    assert hits >= 0.9 * 5 * len(got)
    assert [i for i, _ in (got[100][r] for r in range(1, 6))] == [101, 102, 103, 104, 105]


def test_recall_of_one_graph_at_the_size_of_a_shard():
    """32,768 points, as many as production shards hold: 0.9 of the nearest at least are found."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(32_768, 64))
    unit = neighbours._unit(x)
    graph = neighbours.build(unit)
    asked = unit[:: 32_768 // 150]
    got, _ = neighbours.search(graph, asked, 200)
    want = np.argsort(-(asked @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(g[:6]) & set(w)) / 6 for g, w in zip(got.tolist(), want.tolist(), strict=True)]) >= 0.9


def test_nearest_keeps_what_is_as_near_in_four_bytes(spark):
    """Vectors on one line tie in double precision; ties go to the smallest identifiers, though no vectors are equal."""
    base = np.random.default_rng(3).normal(size=16)
    rows = [(i, (base * 2.0 ** (i % 40 - 20)).tolist()) for i in range(40)] + [(100 + i, np.random.default_rng(i).normal(size=16).tolist()) for i in range(60)]
    got = [tuple(r)[:3] for r in neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_mod=1000).collect()]
    assert sorted(got) == [(0, r, r) for r in range(1, 6)]


def test_nearest_with_one_common_vector(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [float(i + 1), 1.0]) for i in range(3000)]
    got = {}
    for r in neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), query_mod=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 3000, 50))
    for q in (50, 100, 2950):
        assert [v for _, v in sorted(got[q])] == [1, 2, 4, 5, 7]


def test_nearest_with_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.nearest(spark, df).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>a</p></article><article class='comment'><p>reader says</p></article>", "a"),
    ("<article id='post-related-work'><p>text</p><article class='user comments'><p>no</p><p>no</p></article><p>more</p></article><article class=sponsored>buy</article>", "text\nmore"),
    ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p>One\n two<br>three<p>Four &lt;5&gt; &eacute;<!-- no --><aside>side</aside></article><section class='comments'><p>nice</p></section><footer>&copy; me</footer>", "Head & line\nOne two three\nFour <5> é"),
    ("<article><p>Text<div class=\"cookie-notice\">We use</div><p>More <form>x<input></form></article><p>cut <a hre", "Text\nMore"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<p>a<!-- open", "a"), ("<article><p>Fish &am", "Fish &am"),
    ("<main><header><h1>T</h1></header><p hidden>no</p><p>yes</p></main>", "T\nyes"),
])
def test_main_text(page, text):
    assert html_text.text_of(html_text.lines(page or ""), None) == text


def test_common_subsequence_against_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = sorted(html_text.shared(a, b))
        assert len(found) == best[-1, -1]
        at = 0
        for i in found:
            at = b.index(a[i], at) + 1


def test_common_subsequence_of_halved_tables(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (3, 40, 90):
        a, b = rng.integers(0, 6, n).tolist(), rng.integers(0, 6, n + 5).tolist()
        whole = html_text.shared(a, b)
        monkeypatch.setattr(html_text, "TABLE", 16)
        halved = html_text.shared(a, b)
        monkeypatch.undo()
        assert len(whole) == len(halved)
        at = 0
        for i in sorted(halved):
            at = b.index(a[i], at) + 1


def test_differencing_of_neighbours(spark):
    page = "<html><body><div>Site name</div><div>{}</div><p>{}</p><div>All rights</div></body></html>"
    rows = [(i, f"http://h.org/a/{i}", page.format(f"Title {i}", f"Body {i}")) for i in range(4)] + [(9, "http://other.org/x", "<p>alone</p>"), (10, None, None), (9, "http://other.org/x", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    out = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert out == sorted([(i, f"Title {i}\nBody {i}", 14) for i in range(4)] + [(9, "alone", 5), (10, "", 0), (9, "alone", 5)])
    assert html_text.extract(df.limit(0)).count() == 0


def test_differencing_against_brute_force_for_any_partitions(spark):
    """Neighbours by url over the whole table, whatever the partitions; other columns of clashing names; urls that repeat."""
    import os.path
    import re

    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        host, path = f"h{i % 3}.org", f"/{'abc'[int(rng.integers(3))]}/{int(rng.integers(40))}"
        body = "".join(f"<p>{'shared' if x < 4 else 'own'} {host if x < 4 else i} {x}</p>" for x in rng.permutation(8))
        rows.append((i if i != 7 else None, None if i == 5 else f"https://{host}{path}" + ("?q=1" if i % 11 == 0 else ""), f"<div>{host} menu</div>{body}<div>end</div>" if i % 9 else f"<article>{body}</article><div>end</div>", "x", i))
    rows += [rows[3], rows[3], (200, "https://h0.org/zzz", "", "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, near int")
    split = lambda u: (m[1].lower(), m[2]) if (m := re.match(r"https?://([^/?#]*)([^?#]*)", u or "")) else ("", u or "")
    names = sorted({(*split(u), u or "") for _, u, *_ in rows})
    want = []
    for doc, url, html, *_ in rows:
        blocks = html_text.lines(html)
        i = names.index((*split(url), url or ""))
        near = [names[j] for j in (i - 1, i + 1) if 0 <= j < len(names) and names[j][0] == names[i][0]]
        best = max(near, key=lambda x: len(os.path.commonprefix([x[1], names[i][1]])), default=None)
        other = best and min(((d is None, d or 0), h) for d, u, h, *_ in rows if (u or "") == best[2])[1]
        text = html_text.text_of(blocks, best and [t for t, _ in html_text.lines(other)])
        want.append((str(doc), str(url), text, len(text)))
    for parts in (1, 8, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [(str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract(df.repartition(parts)).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert sorted(got) == sorted(want)


def test_differencing_decides_inside_marked_articles(spark):
    """What neighbours share goes from articles too, but for running text; versions of one article tell nothing about it."""
    page = "<nav>Home</nav><article><div>Send this on</div><h1>{0}</h1><p>Quoted by all</p><p>Much longer body of page {0}</p><ul><li><a href='/'>All stories</a></li><li>Item</li></ul><div>Own {0}</div></article>"
    rows = [(i, f"http://h.org/a/{i}", page.format(i)) for i in range(3)]
    rows += [(10 + i, f"http://v.org/a?v={i}", f"<article><div>Opening</div><p>One long text in two versions</p><div>Close {i}</div></article>") for i in range(2)]
    rows += [(20 + i, f"http://w.org/{i}", f"<main><div>One long text, no running</div><div>{i}</div></main>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 5):
        got = {r.page_id: r.text for r in html_text.extract(df.repartition(parts)).collect()}
        assert got == {i: f"{i}\nQuoted by all\nMuch longer body of page {i}\nItem\nOwn {i}" for i in range(3)} | {10 + i: f"Opening\nOne long text in two versions\nClose {i}" for i in range(2)} | {20 + i: f"One long text, no running\n{i}" for i in range(2)}


def test_differencing_of_a_url_of_many_pages(spark, monkeypatch):
    """Pages of one url are dealt to parts; each still meets its neighbour, once."""
    monkeypatch.setattr(html_text, "PART", 3)
    rows = [(i, "http://h.org/a", f"<div>Site</div><p>{i}</p>") for i in range(20)] + [(99, "http://h.org/b", "<div>Site</div><p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(df).collect()) == [*((i, str(i)) for i in range(20)), (99, "b")]


@pytest.mark.parametrize("page", ["<a href=\"x " * 30_000, "<div>" * 30_000 + "</span>" * 30_000, "<p a='" * 30_001 + ">text", "<script " * 30_000, "<!-- " * 30_000, "<div>x</p>" * 30_000, "&" * 100_000, "<" * 100_000])
def test_hostile_pages_take_linear_time(page):
    import time

    start = time.process_time()
    html_text.lines(page)
    assert time.process_time() - start < 2


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en"), (10_002, "12 !", "en"), (None, "", None), (10_003, "x", None)], "doc_id long, text string, lang string")
    known = docs.select("doc_id", "text", "lang")
    both = known.unionByName(odd)
    got = {r.doc_id: r for r in language.languages(spark, both).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (10_001, 10_002, None))
    truth = {r.doc_id: r.lang for r in known.collect()}
    held = [i for i in truth if got[i].held_out]
    assert 20 < len(held) < 90
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.languages(spark, both.limit(0)).count() == 0


def test_sample_is_bounded_whatever_the_identifiers(spark, monkeypatch):
    """Null identifiers and groups of equal rows, both more than the bound; clashing column names."""
    twin = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(None, f"un texte numéro {i} de la langue", "fr", "x", 0.5) for i in range(900)] + [(twin, "the same text", "en", "x", 0.5)] * 900 + [(i, f"ein text {i}", "de", "x", 0.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    seen = {}
    monkeypatch.setattr(language, "build", lambda counts, totals, share: seen.update(totals) or language.Filter(sorted(totals), np.zeros((1, 1), np.uint64), np.zeros(len(totals))))
    for parts in (1, 7):
        seen.clear()
        language.train(spark, docs.repartition(parts), per_language=50)
        assert (seen["fr"], seen["en"]) == (50, 50) and 20 <= seen["de"] <= 40
    monkeypatch.undo()
    got = language.languages(spark, docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows)


@pytest.mark.parametrize("n", [5, 130])
def test_filters_against_whole_sets(n):
    """Shares of n-grams and choices as by the sets themselves, for more languages than a mask has bits too."""
    from collections import Counter

    rng = np.random.default_rng(n)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = [["".join(rng.choice(letters, 5)) for _ in range(25)] for _ in range(n)]
    write = lambda i, k: " ".join(words[i if rng.random() < 0.9 else int(rng.integers(n))][int(rng.integers(25))] for _ in range(k))
    counts = {f"l{i:03d}": Counter() for i in range(n)}
    for i, c in enumerate(counts.values()):
        for _ in range(12):
            c.update(np.unique(language.grams(write(i, 60))).tolist())
    totals = dict.fromkeys(counts, 12)
    model = language.build(counts, totals)
    best = Counter()
    for lang, c in counts.items():
        for g, k in c.items():
            best[g] = max(best[g], k / totals[lang])
    sets = [{g for g, k in c.items() if k > 1 and k / totals[lang] >= 0.25 * best[g]} for lang, c in counts.items()]
    for i in range(0, n, max(1, n // 30)):
        text = write(i, 200)
        h = language.grams(text).tolist()
        shares = [sum(g in s for g in h) / len(h) for s in sets]
        lang, score = language.predict(model, text)
        assert lang == f"l{int(np.argmax(shares)):03d}" == f"l{i:03d}" and abs(score - max(shares)) < 0.02


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, written and read again."""
    import re
    import zlib
    from collections import Counter

    import corpus_pipeline as pipeline
    from folioloom.llm import mixing, tokens

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    extra = [(90_001, "?! 12", "en", "src0", 5), (90_002, None, None, None, 0), (90_003, "", "en", "src0", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, at).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            kept[name] = {r.doc_id: r for r in after.collect()}
            assert after.count() == len(kept[name])
        if name == "language":
            assert set(kept[name]) == {d for d in before if d < 90_000}
        if name == "near_duplicates":
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            sets = {}
            for d, r in sorted(before.items()):
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(low))
                sets[d] = frozenset(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
            label = {d: d for d in sets}
            for d in sets:
                for e in sets:
                    if e < d and label[d] != label[e] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                        old, new = max(label[d], label[e]), min(label[d], label[e])
                        label = {k: new if v == old else v for k, v in label.items()}
            assert set(kept[name]) == {d for d, v in label.items() if d == v}
            assert all(kept[name][d] == before[d] for d in kept[name])
        if name == "repeated_strings":
            data = {d: r.text.encode() for d, r in before.items()}
            seen = Counter(b[s : s + 200] for b in data.values() for s in range(len(b) - 199))
            for d, b in data.items():
                cover = bytearray(len(b))
                for s in range(len(b) - 199):
                    if seen[b[s : s + 200]] > 1:
                        cover[s : s + 200] = b"\1" * 200
                for m in re.finditer(b"\1+", bytes(cover)):  # characters stay whole
                    x, y = m.span()
                    while x < y and b[x] & 0xC0 == 0x80:
                        cover[x], x = 0, x + 1
                    while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
                        y -= 1
                        cover[y] = 0
                left = bytes(c for c, m in zip(b, cover, strict=True) if not m).decode()
                if left or not any(cover):
                    assert kept[name][d].text == left and kept[name][d].n_chars == len(left)
                else:
                    assert d not in kept[name]
        if name == "mixing":
            assert kept[name] == before
            # Written files in order hold the mixture: the sources of the plan, block by block.
            order = [r.source for f in sorted((tmp_path / name).glob("part-*.parquet")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
            counts = Counter(order)
            planned = mixing.plan(mixing.size_weights(counts, 0.5), {s: -(-n // 64) for s, n in counts.items()})
            assert order == [s for s, j, _ in planned for _ in range(min(64, counts[s] - 64 * j))]
        if name == "packing":
            own, want = tokens.encoder(pipeline.public_tokenizers.path("word_bpe_49k.json")), Counter()
            for d, r in before.items():
                ids = own.encode(r.text) + b"\x01\0\0\0"
                for piece, x in enumerate(range(0, len(ids), 4 * 4096)):
                    want[d, piece, len(ids[x : x + 4 * 4096]) // 4, zlib.crc32(ids[x : x + 4 * 4096])] += 1
            rows = after.collect()
            assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == want
            fill = {}
            for r in rows:
                fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for parts in fill.values():
                parts.sort()
                assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
        docs = after


def test_pipeline_runs_as_one(spark):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_on_odd_tables(spark, tmp_path, some):
    """Nulls in every column, repeated rows, columns named like those of operators; and the same without any row."""
    import corpus_pipeline as pipeline

    texts = [" ".join(f"wort{i * j % 97}" for j in range(1, 40)) for i in range(1, 9)]
    rows = [(i if i % 3 else None, t, "de" if i % 2 else None, None if i % 4 == 0 else "s", len(t)) for i, t in enumerate(texts)] + [(50, texts[0], "de", "s", 1)] * 2 + [(51, None, None, None, None), (52, "", "de", "s", 0)]
    odd = [(*r, "x", 1, 2.0, True) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, component_id int, score double, kept boolean"
    spark.createDataFrame(odd if some else [], schema).write.parquet(str(tmp_path / "documents.parquet"))
    found = pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) == (len({t for t in texts}) if some else 0) and sum(r["doc_id"] is None for r in found) <= 3


def test_packed_sequences_follow_the_mixture(spark, monkeypatch):
    """Every prefix of the sequences has each source's share to within a window, whatever order the rows come in."""
    import corpus_pipeline as pipeline
    from folioloom.llm import mixing, packing

    monkeypatch.setattr(packing, "WINDOW", 256)
    size = {"a": 2500, "b": 400, None: 100}
    rows = [(10_000 * k + i, f"word {i} " * (1 + i % 7), "en", s, 0) for k, (s, n) in enumerate(size.items()) for i in range(n)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = pipeline.packed(spark, spark.createDataFrame(rows, schema).repartition(5), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert {r.sequence_id for r in got} == set(range(max(r.sequence_id for r in got) + 1))
    where = {r[0]: r[3] for r in rows}
    slots = {r.doc_id: r.position for r in mixing.schedule(spark, spark.createDataFrame(rows, schema)).collect()}
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    plan = sorted(slots, key=slots.get)
    for n in range(256, len(order) + 1, 100):
        for s in size:
            assert abs(sum(where[d] == s for d in order[:n]) - sum(where[d] == s for d in plan[:n])) <= 256
    assert all(slots[d] // 256 == i // 256 for i, d in enumerate(order))
