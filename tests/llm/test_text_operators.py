"""Packing, storing, sharding, mixing, repeated strings, near duplicates and search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.llm import bm25, mixing, near_dups, packing, repeats, sharding, token_store, tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, slot int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words, n))
    base, passage = make(120), make(60)
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in base.split()) for _ in range(12)]
    out = [None, "", "   \n", "…!?", "Word", "Two words", base, base, base, *near, make(9000)]
    out += [make(30) + " " + passage + " " + make(30) for _ in range(6)]
    out += ["abc" * 300, "abc" * 150] + [make(int(n)) for n in rng.integers(1, 200, 30)]
    return [(i if i != 5 else None, t, "en", None if i % 3 == 0 else "hot" if i % 3 == 1 else f"s{i % 5}", 0, "x", 1) for i, t in enumerate(out)] + [(7, base, "en", "hot", 0, "x", 1)]


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_the_library():
    own = tokens.Encoder(TOKENIZER)
    assert own.fast
    for text in ("It's ŒUVRE  'S straße n°1², \x85\x1c x<|endoftext|>y Σ é İ 漢字 don't\xa0stop", "", "Á"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_encoder_leaves_other_tokenizers_to_the_library(tmp_path):
    """A file that differs in any rule is encoded by the library as a whole."""
    import json

    told = json.loads(tokens.Encoder(TOKENIZER).whole.to_str())
    told["normalizer"]["normalizers"][1]["content"] = "-"
    (tmp_path / "t.json").write_text(json.dumps(told))
    own = tokens.Encoder(str(tmp_path / "t.json"))
    assert own.fast is None
    text = "two  words\nhere"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_places_every_rank_once_without_overflow(counts):
    runs, used = packing.plan(counts, 40)
    fill, ranks = {}, Counter()
    for length, rank, n, first, offset in runs:
        for i in range(n):
            ranks[length, rank + i] += 1
            fill.setdefault(first + i, []).append((offset, length))
    assert ranks == Counter((length, r) for length, n in counts.items() for r in range(n))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert set(fill) == set(range(used))
    room = []  # best fit of one piece after another, longest first
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        best = min((r for r in room if r >= length), default=None)
        if best is not None:
            room.remove(best)
        room.append((40 if best is None else best) - length)
    assert used == len(room)


def test_packing(spark, docs, rows, empty):
    own = tokens.encoder(TOKENIZER)
    want = Counter()
    for doc, text, *_ in rows:
        ids = own.encode(text) + b"\x01\0\0\0"
        for piece, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            want[doc, piece, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    got = packing.pack(spark, docs, TOKENIZER).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(fill) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(spark, empty, TOKENIZER).count() == 0


def test_token_store_round_trip(spark, docs, rows, empty):
    own = tokens.encoder(TOKENIZER)
    manifest, _ = token_store.store_tokens(spark, docs, TOKENIZER, block_bytes=2000)
    got = [tuple(r) for r in token_store.read_shards(manifest).collect()]
    want = Counter((doc, len(ids := own.encode(text) + b"\x02\0\0\0") // 4, zlib.crc32(ids)) for doc, text, *_ in rows)
    assert Counter((d, n, crc) for d, _, n, crc in got) == want
    got.sort(key=lambda r: r[1])
    at, last = 0, None
    for d, start, n, _ in got:
        assert start == at and (last is None or d >= last)
        at, last = at + n, d if d is not None else last
    shards = [token_store.open_shard(r.uri) for r in manifest.collect()]
    for doc in {r[0] for r in rows}:
        found = [ids for s in shards for ids in s.lookup(doc)]
        assert Counter(found) == Counter(own.encode(t) + b"\x02\0\0\0" for d, t, *_ in rows if d == doc)
    assert not any(s.lookup(10**9) or s.lookup(-5) for s in shards)
    manifest, _ = token_store.store_tokens(spark, empty, TOKENIZER)
    assert token_store.read_shards(manifest).count() == 0


def test_bloom_filter_lets_few_other_keys_through():
    import io

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    out = File()
    writer = token_store.ShardWriter(out)
    for i in range(20_000):
        writer.add(token_store.key_of(3 * i), b"\1\0\0\0")
    writer.close()
    reader = token_store.ShardReader(out)
    assert all(reader.may_hold(token_store.key_of(3 * i)) for i in range(0, 20_000, 7))
    through = sum(reader.may_hold(token_store.key_of(3 * i + 1)) for i in range(20_000))
    assert through < 0.015 * 20_000  # 0.0082 is expected of 10 bits a key and 7 hashes


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard(spark, docs, shards=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(4))
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    copies = [r.shard for r in got if r.text_crc32 == zlib.crc32(rows[6][1].encode())]
    assert len(copies) >= 4 and len(set(copies)) == 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard(spark, empty).count() == 0


def test_sharding_keeps_groups_whole(spark):
    """20 groups of 300 copies among 10,000 documents fit whole into 16 shards."""
    df = spark.range(10_000).selectExpr("id AS doc_id", "CASE WHEN id < 6000 THEN concat('group ', id % 20) ELSE concat('own ', id) END AS text")
    got = sharding.shard(spark, df.repartition(3)).collect()
    assert Counter(Counter(r.shard for r in got).values()) == {625: 16} and len({r.doc_id for r in got}) == 10_000
    held = {}
    for r in got:
        if r.doc_id < 6000:
            held.setdefault(r.doc_id % 20, set()).add(r.shard)
    assert sorted(len(s) for s in held.values()) == [1] * 20


@pytest.mark.parametrize("sizes", [(31, 7, 34, 27), (31, 28, 38, 22)])
def test_sharding_cuts_few_links(spark, sizes):
    """Links cut (pairs of one group in different shards) against the best of all ways to keep groups whole: none where they fit, else under a tenth of all links."""
    import itertools
    import random

    rows = [f"g{i}" for i, n in enumerate(sizes) for _ in range(n)]
    rows += [f"own{i}" for i in range(120 - len(rows))]
    random.Random(1).shuffle(rows)
    got = sharding.shard(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shards=3).collect()
    pairs = lambda n: n * (n - 1) // 2
    held = Counter((rows[r.doc_id], r.shard) for r in got)
    cut = sum(pairs(n) for n in sizes) - sum(pairs(n) for (g, _), n in held.items() if g.startswith("g"))
    fits = any(all(sum(n for n, s in zip(sizes, ways, strict=True) if s == x) <= 40 for x in range(3)) for ways in itertools.product(range(3), repeat=len(sizes)))
    assert cut == 0 if fits else cut < 0.1 * sum(pairs(n) for n in sizes)


def test_sharding_splits_a_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(160)], "doc_id long, text string")
    got = sharding.shard(spark, df, shards=8).collect()
    assert set(Counter(r.shard for r in got).values()) == {20}
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same")}) <= 4


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-6, 1e6), st.integers(0, 60)), min_size=1, max_size=9))
def test_schedule_stays_within_a_block_of_the_weights(given_sources):
    """After every slot each source is within one block of min(w t, B), to the end; w is the weight itself, not rounded."""
    from fractions import Fraction

    weights = {f"s{i}" if i else None: w for i, (w, _) in enumerate(given_sources)}
    blocks = {s: b for s, (_, b) in zip(weights, given_sources, strict=True)}
    out = list(mixing.plan(weights, blocks))
    assert [t for *_, t in out] == sorted({t for *_, t in out})
    assert Counter(s for s, *_ in out) == Counter({s: b for s, b in blocks.items() if b})
    total = sum(map(Fraction, weights.values()))
    part = {s: Fraction(w) / total for s, w in weights.items()}
    seen = dict.fromkeys(weights, 0)
    for s, j, slot in out:
        # Just before the slot and just after it: between slots used, targets only move away from what is put in at known ends.
        for t, n in ((slot, seen[s]), (slot + 1, seen[s] + 1)):
            assert abs(n - min(part[s] * t, blocks[s])) < 1
        assert j == seen[s]
        seen[s] += 1
        for x in weights:
            assert abs(seen[x] - min(part[x] * (slot + 1), blocks[x])) < 1


def test_schedule_equals_a_walk_over_all_slots():
    """Earliest deadline first, slot by slot, by the windows of the weights."""
    weights, blocks = {"a": 0.7, "b": 0.0001, "c": 0.2999, None: 0.0}, {"a": 50, "b": 3, "c": 40, None: 2}
    from fractions import Fraction

    exact = {s: Fraction(w) for s, w in weights.items()}
    inverse = {s: sum(exact.values()) / exact[s] for s in "abc"}
    done, want, t = dict.fromkeys(weights, 0), [], 0
    while any(done[s] < blocks[s] for s in "abc"):
        free = [(math.ceil((done[s] + 1) * inverse[s]), s) for s in "abc" if done[s] < blocks[s] and math.floor(done[s] * inverse[s]) <= t]
        if free:
            s = min(free)[1]
            want.append((s, done[s], t))
            done[s] += 1
        t += 1
    want += [(None, 0, want[-1][2] + 1), (None, 1, want[-1][2] + 2)]
    assert list(mixing.plan(weights, blocks)) == want


def test_mixing(spark, docs, rows, empty):
    weights = {"hot": 0.5, None: 0.3, "s1": 0.15, "s2": 0.05}
    for given_weights in (None, weights):
        got = mixing.schedule(spark, docs, given_weights, block_rows=2).collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, _, _, s, *_ in rows)
        got.sort(key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(rows)))
        counts = Counter(r.source for r in got)
        used = mixing.size_weights(counts, 0.5) if given_weights is None else {s: given_weights.get(s, 0.0) for s in counts}
        want = list(mixing.plan(used, {s: -(-n // 2) for s, n in counts.items()}))
        assert list(dict.fromkeys((r.source, r.block, r.slot) for r in got)) == want
        for (s, b, _), n in Counter((r.source, r.block, r.slot) for r in got).items():
            assert n == 2 or (n == 1 and b == counts[s] // 2)
        mix = mixing.mix(spark, docs, given_weights, block_rows=2)
        assert mix.columns == docs.columns
        mixed = mix.collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        assert sorted(map(tuple, mixed), key=key) == sorted(rows, key=key)
        assert [r.source for r in mixed] == [r.source for r in got]
    assert mixing.schedule(spark, empty).count() == 0 and mixing.mix(spark, empty).count() == 0


def _repeated(data, length):
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    for b in data:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        yield bytes(cover)


def _repeats_expected(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    for (d, *_), b, cover in zip(rows, data, _repeated(data, length), strict=True):
        left = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        yield d, len(b), len(b) - len(left), len(re.findall(b"\1+", cover)), hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_strings(spark, docs, rows, empty, monkeypatch, hot):
    if hot:  # all buckets are refined over the cluster
        monkeypatch.setattr(repeats, "LARGE", 1)
        monkeypatch.setattr(repeats, "FREQUENT", 3)
    for length, q in ((200, 64), (50, 30)):
        got = Counter(tuple(r) for r in repeats.spans(spark, docs.coalesce(1) if hot else docs, length, q).collect())
        assert got == Counter(_repeats_expected(rows, length))
    assert repeats.spans(spark, empty).count() == 0


def test_repeats_hot_path_in_workers():
    """The task functions with small limits: rare and frequent q-grams of one bucket end alike."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"salt": pa.array([0, 0, 0, 1, 2], pa.int32()), "gram": pa.array([5, 5, 6, 5, 5]), "key": pa.array([b"a" * 16, None, b"b" * 16, b"c" * 16, b"d" * 16], pa.binary()), "times": [1, 2, 1, 1, 1], "hot": [False, True, False, True, True]})
    out = pa.Table.from_batches(repeats._alive(iter([batch]))).to_pylist()
    assert [(r["key"][:1], r["large"]) for r in out] == [(b"a", True), (b"c", True), (b"d", True)]


def test_repeats_stream_a_bucket_as_one(monkeypatch):
    """A q-gram of few texts with many copies is large for all of its texts, the first held ones too."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "LARGE", 5)
    keys = [bytes([i]) * 16 for i in range(3) for _ in range(15)]
    t = pa.table({"gram": pa.array([7] * 45 + [8, 8], pa.int64()), "key": pa.array([*keys, keys[0], keys[-1]], pa.binary()), "times": [1] * 47, "hot": [False] * 47, "salt": pa.array([0] * 47, pa.int32())})
    for most in (4, 7, 21, 47):
        out = pa.Table.from_batches(repeats._alive(iter(t.to_batches(most)))).to_pylist()
        assert {(r["key"], r["gram"]) for r in out} == {(k, 7) for k in keys} | {(keys[0], 8), (keys[-1], 8)}
        assert len({r["large"] for r in out if r["gram"] == 7}) == 1 and not any(r["large"] for r in out if r["gram"] == 8)


def test_repeats_keep_characters(spark):
    df = spark.createDataFrame([(1, "é" * 3 + "x" * 60 + "è"), (2, "ü" + "x" * 60 + "é"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in repeats.deduplicate(spark, df, 50, 20).collect()}
    assert out == {1: "ééé" + "è", 2: "ü" + "é", 3: None}


def _sets(rows, k):
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        yield d, frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(sets, percent):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("percent", [80, 85, 50, 95, 100])
def test_matches_follow_the_similarity(percent):
    """A pair of just that similarity is missed with a chance of 1 in 100,000 at most, and one agreement more would miss more."""
    t, p, m = near_dups.matches(percent), percent / 100, near_dups.COORDINATES
    below = lambda t: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(t))
    assert below(t) <= 1e-5 and (t == m or below(t + 1) > 1e-5)
    rng = np.random.default_rng(percent)
    for _ in range(30):  # and signatures of such pairs do agree in so many places
        n = 2000
        both = round(2 * n * p / (1 + p))
        words = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        sig = near_dups.signatures(np.concatenate((np.sort(words[:n]), np.sort(words[n - both :]))), np.array([0, n, 2 * n]))
        assert (sig[0] == sig[1]).sum() >= t


@pytest.mark.parametrize(("block", "many"), [(4096, 20_000), (4, 3)])
def test_near_duplicates(spark, docs, rows, empty, monkeypatch, block, many):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "LONG", many)
    for k, percent in ((3, 85), (5, 80)):
        sets = list(_sets(rows, k))
        label = _components(sets, percent)
        least = {}
        for (d, _), c in zip(sets, label, strict=True):
            if d is not None:
                least[c] = min(d, least.get(c, d))
        want = Counter((d, len(s), least.get(c), d == least.get(c)) for (d, s), c in zip(sets, label, strict=True))
        assert Counter(tuple(r) for r in near_dups.cluster(spark, docs, k, percent).collect()) == want
    assert near_dups.cluster(spark, empty).count() == 0


def test_near_duplicates_keep_one(spark, docs, rows):
    out = near_dups.deduplicate(spark, docs)
    assert out.columns == docs.columns
    sets = list(_sets(rows, 5))
    assert out.count() == len(set(_components(sets, 80)))


def test_near_duplicates_keep_rows_of_null_and_repeated_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, None), (None, ""), (4, text("c")), (4, text("d")), (9, text("e")), (9, text("f")), (3, text("e") + " more"), (2, text("b")), (8, ""), (8, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, text("a")), (None, None), (None, ""), (4, text("c")), (4, text("d")), (9, text("f")), (3, text("e") + " more"), (2, text("b")), (8, ""), (8, None)]
    assert Counter(tuple(r) for r in near_dups.deduplicate(spark, df).collect()) == Counter(want)
    assert near_dups.deduplicate(spark, df.limit(0)).count() == 0


def test_bm25(spark, docs, rows, empty):
    plain = {ord(c): " " for c in map(chr, range(128)) if not c.isalnum()}
    held = [(d, Counter((t or "").translate(LOW).translate(plain).split(" "))) for d, t, *_ in rows if d is not None]
    held = [(d, {w: n for w, n in c.items() if w}) for d, c in held]
    full = [c for _, c in held if c]
    df, mean = Counter(w for c in full for w in c), sum(sum(c.values()) for c in full) / len(full)
    want = set()
    for q, terms in held:
        if q % 4:
            continue
        scores = {}
        for d, c in held:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(math.log1p((len(full) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in terms if w in c)
            if s > 0:
                scores[d] = max(s, scores.get(d, 0))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        want |= {(q, i, d, round(s, 6)) for i, (d, s) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in bm25.search(spark, docs, docs.where("doc_id % 4 = 0"), k=5).collect()}
    assert got == want
    assert bm25.search(spark, empty, empty).count() == 0


def _index(entries, mean):
    terms = [np.array(sorted(e), np.uint64) for e in entries]
    return bm25.Index(bm25.stored([[i] for i in range(len(entries))], terms, [np.array([e[t] for t in sorted(e)]) for e in entries], [sum(e.values()) for e in entries], 5), mean, 1.2, 0.75)


@pytest.mark.parametrize(("dense", "step"), [(1, 1), (4, 1), (4, 3), (10**6, 64)])
def test_bm25_skips_blocks_and_loses_nothing(monkeypatch, dense, step):
    """Against scores of all entries, with few dense lists, some or all; entries of one subject lie together."""
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "STEP", step)
    monkeypatch.setattr(bm25, "DENSE", dense)
    rng = np.random.default_rng(2)
    entries = [Counter([*rng.integers(0, 12, 15).tolist(), *(100 + 10 * (i // 40) + rng.integers(0, 10, 6)).tolist()]) for i in range(400)]
    entries[333] = entries[17]
    index = _index(entries, 21.0)
    queries = [(np.array(sorted(e), np.uint64), rng.uniform(0.1, 3, len(e))) for e in entries[::9]] + [(np.array([5000], np.uint64), np.ones(1)), (np.zeros(0, np.uint64), np.zeros(0))]
    for (t, w), (found, scores) in zip(queries, index.search_many(queries, 5), strict=True):
        norm = [1.2 * (0.25 + 0.75 * sum(e.values()) / 21.0) for e in entries]
        full = np.round([sum(x * e[y] * 2.2 / (e[y] + n) for y, x in zip(t.tolist(), w.tolist(), strict=True) if y in e) for e, n in zip(entries, norm, strict=True)], 9)
        best = np.flatnonzero((full > 0) & (full >= np.sort(full)[-5]))
        assert np.array_equal(np.sort(found), best)
        assert np.allclose(scores[np.argsort(found)], full[best], rtol=0, atol=2e-9)
    if step < 64:
        assert index.read < 0.7 * len(queries) * index.blocks


def test_bm25_puts_like_entries_together_and_reads_fewer_blocks():
    """Entries of three languages in turn: in order of likeness a query's bound rules out the blocks of the others, and nothing is lost."""
    rng = np.random.default_rng(5)
    entries = [Counter((1000 * (i % 3) + np.minimum(rng.geometric(0.01, 60), 999)).tolist()) for i in range(1800)]
    held = lambda **more: bm25.stored([[i] for i in range(len(entries))], [np.array(sorted(e), np.uint64) for e in entries], [np.array([e[t] for t in sorted(e)]) for e in entries], [60] * len(entries), 5, **more)
    df = Counter(t for e in entries for t in e)
    queries = [(np.array(sorted(e), np.uint64), np.array([math.log1p((len(entries) - df[t] + 0.5) / (df[t] + 0.5)) for t in sorted(e)])) for e in entries[::20]]
    found, read = [], []
    for like in (False, True):
        index = bm25.Index(held(like=like), 60.0, 1.2, 0.75)
        best = list(index.search_many(queries, 5))
        found.append([sorted(zip(index.ids[index.of_ids[e]].tolist(), scores.tolist(), strict=True)) for e, scores in best])
        read.append(index.read)
    assert found[0] == found[1]
    assert read[1] < 0.6 * read[0]


@pytest.mark.parametrize("blocks", [1, 3])
def test_bm25_deals_queries_and_shards(spark, docs, monkeypatch, blocks):
    """The same rows whether one task reads all shards or queries and shards are dealt to blocks and groups."""
    asked = docs.where("doc_id % 4 = 0")
    want = sorted(map(tuple, bm25.search(spark, docs, asked, k=5).collect()))
    monkeypatch.setattr(bm25, "SHARD_GROUP", 1)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", -(-asked.count() // blocks))
    assert sorted(map(tuple, bm25.search(spark, docs.repartition(5), asked, k=5).collect())) == want


def test_bm25_takes_equal_texts_of_all_partitions_as_one_entry(spark, monkeypatch):
    """A table of copies makes indexes of its different texts only, in few files, with the statistics of all rows and the smallest identifiers."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 25)) for _ in range(30)] + ["--", "", None]
    rows = [(33 * copy + i, t) for copy in range(12) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[6]), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, store = [], bm25.Scratch.store

    def spied(self, df, name):
        out = store(self, df, name)
        if name == "manifest":
            made.append([r.entries for r in out.collect()])
        return out

    monkeypatch.setattr(bm25.Scratch, "store", spied)
    found = [sorted(map(tuple, bm25.search(spark, df.repartition(n), df.where("doc_id < 33"), k=4).collect())) for n in (1, 7)]
    assert made == [[30], [30]] and found[0] == found[1]
    best = {(q, rank): doc for q, rank, doc, _ in found[0]}
    assert all(best[i, rank] == i + 33 * (rank - 1) for i in range(30) if i not in (5, 6) for rank in (1, 2, 3, 4))
    norm, n = 1.2, 362  # texts of one length; a null identifier takes no part
    df_of = Counter(w for i, t in rows if t and t != "--" and i is not None for w in set(t.split()))
    want = sum(math.log1p((n - df_of[w] + 0.5) / (df_of[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in Counter(texts[0].split()).items())
    assert sum(1 for i, t in rows if t and t != "--" and i is not None) == n
    assert abs(next(s for q, rank, _, s in found[0] if (q, rank) == (0, 1)) - want) < 1e-6


def test_bm25_deals_queries_to_all_cores():
    """Blocks of queries times groups of shards are as many as cores or a little fewer, or equally many for each core."""
    assert bm25.dealing(12_821, 18, 6) == (6, 1) and bm25.dealing(2_564, 5, 6) == (2, 2) and bm25.dealing(30, 1, 8) == (1, 1)
    assert bm25.dealing(0, 0, 4) == (1, 1) and bm25.dealing(154_000, 168, 6) == (24, 1)


def test_bm25_counts_documents_from_the_indexes(spark, monkeypatch):
    """Texts are cut into words once, for the indexes: global frequencies come from them, with copies, repeated identifiers and cut lists counted."""
    import pyarrow as pa

    texts = ["a b b c", "c b B a", "a b b c", None, "", "--", "c d", "e", "c d"]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 7]
    monkeypatch.setattr(bm25, "SHARD_WORDS", 5)
    monkeypatch.setattr(bm25, "HELD_TERMS", 2)
    built = pa.Table.from_batches(bm25._build(bm25.Scratch(spark, "bm25-test").sub("indexes"), 3)(iter([pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts})])))
    assert len(built) == 4
    got = Counter()
    for r in pa.Table.from_batches(bm25._frequencies(iter(built.select(["uri"]).to_batches()))).to_pylist():
        got += Counter({r["term"]: r["n"]}) + (Counter({"words": r["words"]}) if r["term"] is None else Counter())
    code, _ = bm25.hashes(pa.array(["a b c d"]), bm25.PLAIN)
    assert got == {**dict(zip(code.view(np.int64).tolist(), (3, 3, 5, 2), strict=True)), None: 5, "words": 16}


def test_bm25_scores_pairs_over_shared_terms():
    """An entry that several queries found is looked up once; sums are those of each pair by itself, whatever batch it is in."""
    rng = np.random.default_rng(4)
    entries = [Counter(rng.integers(0, 60, 30).tolist()) for _ in range(300)]
    queries = [(np.array(sorted(e), np.uint64), rng.uniform(0.1, 3, len(e))) for e in entries[::10]]
    index = _index(entries, 30.0)
    together = [[x.tolist() for x in found] for found in index.search_many(queries, 5)]
    assert together == [[x.tolist() for x in next(index.search_many([q], 5))] for q in queries]
    assert not index.impact.any()


def test_bm25_copies_in_two_shards_tie():
    """Of two indexes with one text among others, the scores are the same to the last bit."""
    rng = np.random.default_rng(8)
    same = Counter(rng.integers(0, 300, 500).tolist())
    weights = rng.uniform(0.1, 3, len(same))
    query = (np.array(sorted(same), np.uint64), weights)
    scores = set()
    for n in (1, 5, 70):
        index = _index([Counter(rng.integers(0, 400, 50).tolist()) for _ in range(n)] + [same], 60.0)
        scores |= {s for found, got in index.search_many([query], 1) for s in got.tolist()}
    assert len(scores) == 1


def test_bm25_cuts_a_partition_into_shards(spark, monkeypatch):
    """Shards of a partition are searched one after another; documents longer than a shard are one; an identifier with two texts counts once."""
    import pyarrow as pa

    words = [" ".join(f"w{(i * j) % 37}" for j in range(1, 40)) for i in range(1, 30)]
    t, at = bm25.hashes(pa.array(words[:3]), bm25.PLAIN)
    asked = [np.unique(t[a:b]).view(np.int64).tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    asked = pa.RecordBatch.from_pydict({"query": [0, 1, 2], "terms": asked, "weights": [[1.0] * len(x) for x in asked]})
    batch = pa.RecordBatch.from_pydict({"doc_id": [i % 23 for i in range(29)], "text": words})
    found = []
    for most in (10**9, 100, 5):
        monkeypatch.setattr(bm25, "SHARD_WORDS", most)
        scratch = bm25.Scratch(spark, "bm25-test")
        rows = pa.Table.from_batches(bm25._build(scratch.sub("indexes"), 3)(iter([batch]))).to_pylist()
        assert len(rows) == {10**9: 1, 100: 15, 5: 29}[most]
        scratch.store(spark.createDataFrame(rows, "uri string, entries long"), "manifest")
        got = pa.Table.from_batches(bm25._answer(scratch.sub("manifest"), 39.0, 3, 1.2, 0.75)(iter([asked]))).to_pylist()
        assert [(r["query"], r["rank"]) for r in got] == [(q, i) for q in range(3) for i in (1, 2, 3)]
        assert all(len({r["doc_id"] for r in got if r["query"] == q}) == 3 for q in range(3))
        found.append(got)
    assert found[0] == found[1] == found[2]


def test_a_cluster_needs_a_shared_folder():
    """Only a local master may do without spark.checkpoint.dir."""
    from types import SimpleNamespace

    from folioloom.llm import common

    def session(master, told=""):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: told or d), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert common.shared_dir(session("local[8]")).startswith("file:") and common.shared_dir(session("local"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))


def test_scratch_keeps_what_is_named(spark):
    from folioloom.llm.common import Scratch

    scratch = Scratch(spark, "keeping")
    one, two = (scratch.store(spark.range(n), name) for n, name in ((3, "one"), (4, "two")))
    scratch.keep("two")
    assert two.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FAILED_READ_FILE"):
        spark.read.parquet(scratch.sub("one")).count()
    assert one.columns == ["id"]


def test_repeated_starts_against_counts():
    """Strings that agree up to random places and go on differently, cut anywhere: exactly the starts that repeat."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcd", np.uint8)
    for _ in range(6):
        strings = []
        for _ in range(25):
            base = rng.choice(letters, 420)
            for _ in range(8):
                other = base.copy()
                at = int(rng.integers(150, 420))
                other[at:] = rng.choice(letters, 420 - at)
                first = int(rng.integers(0, 120))
                strings.append(other[first : first + int(rng.integers(200, 300))].tobytes())
        owner, start, again = repeats.repeated_starts(strings, 200)
        seen = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
        assert again.tolist() == [seen[strings[o][i : i + 200]] > 1 for o, i in zip(owner.tolist(), start.tolist(), strict=True)]


def test_too_many_sources_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="more than 3 sources"):
        mixing.schedule(spark, docs)
    monkeypatch.setattr(mixing, "MOST_SOURCES", docs.select("source").distinct().count())
    assert mixing.schedule(spark, docs).count() == docs.count()
