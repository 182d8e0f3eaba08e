"""Exact removal of repeated byte strings by bucket-pointer refinement of a sparse suffix order.

Every byte covered by a `length`-byte string that starts at two or more places of the corpus (the same document
included) is removed. Two such starts lie in one bucket of the suffix order to so many bytes.
Only strings that may repeat are brought together:

1.  A start belongs to the q-gram with the smallest identifier in its string, the leftmost if several. Equal strings
    choose the same q-gram at the same offset, and neighbouring starts mostly choose the same one, so one of about
    (length - q) / 2 places stands for all starts. q-grams chosen at one place only are done.
2.  The strings of the runs of starts left are dealt by their q-gram (runs that a text holds twice, as one does that
    repeats a phrase over and over, repeat already; one of them goes on for the others, and equal strings are one).
    `bucket_order` puts the places of those in a task in order: they lie in buckets by an identifier of their first
    FIRST bytes, and each holds the pointer of its bucket. Buckets are refined by sorting their members on the bucket
    pointers at a later offset: that to which they agree, or less, so that the later buckets end at `length` and no
    two places that agree so far are parted. The pointers are updated, and the next pass refines by what this one has
    found, until all agree to `length` bytes or stand alone.
3.  Neighbours in the order are compared byte by byte, so nothing is removed that does not repeat.

Equal texts are refined once. A q-gram that is frequent within one task, or has over LARGE occurrences, is not
gathered: each start of its strings is counted over the cluster by two independent 64-bit identifiers of its bytes,
spread by a salt. There alone, and in telling texts apart (by 128 bits), equality is that of identifiers.

Null texts count as empty. Repeated rows are copies of a text. Very long texts are read in slices that overlap, so
nothing is lost between them. An empty table gives no rows. Other columns, whatever their names, are kept by
`deduplicate` and ignored by `spans`; `spans` counts bytes, `deduplicate` keeps
a character of which only some bytes repeat.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release_memory

#: Occurrences of a q-gram beyond which it is counted over the cluster, and those in one task that make it frequent.
LARGE, FREQUENT = 5_000, 512
#: q-grams that a task holds before it passes them on.
HELD = 1 << 20
#: Bytes of the first buckets.
FIRST = 64
#: Bytes of strings that a task refines at a time.
CHUNK = 1 << 20
_SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BYTES, _OTHER = np.random.default_rng(11).integers(0, 2**64, (2, 256), dtype=np.uint64, endpoint=False)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = lambda b: np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * _SLICE, b, dtype=np.uint64))), dtype=np.uint64)
    return up(np.uint64(_BASE)), up(np.uint64(pow(_BASE, -1, 2**64)))


def gram_ids(data: np.ndarray, q: int, table: np.ndarray = _BYTES) -> np.ndarray:
    """A 64-bit identifier of the q-gram at each place, from prefix sums of a polynomial."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > _SLICE:
        return np.concatenate([gram_ids(data[a : min(a + _SLICE + q - 1, len(data))], q, table) for a in range(0, n, _SLICE)])
    up, down = _powers()
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * down[: len(data)], out=sums[1:])
    return _mix((sums[q:] - sums[:-q]) * up[:n])


def chosen_grams(ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For starts with `span` grams each: the grams chosen, and the first and last start of each."""
    starts = len(ids) - span + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    place_bits = np.uint64(len(ids).bit_length())
    low = (ids >> place_bits << place_bits) | np.arange(len(ids), dtype=np.uint64)
    size = 1
    while size < span:  # sliding minimum by doubling
        step = min(size, span - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    low &= (np.uint64(1) << place_bits) - np.uint64(1)
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    return low[first].astype(np.int64), first, np.concatenate((first[1:] - 1, [starts - 1]))


def _runs(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identifier and place of the grams chosen, first and last start. Places have 22 bits: longer texts go in slices.

    The choice within a string depends on its own grams alone, by their upper 42 bits and then by place.
    """
    piece = 1 << 21
    found = []
    for a in range(0, max(1, len(data) - length + 1), piece):
        part = data[a : a + piece + length - 1]
        ids = gram_ids(part, q) >> np.uint64(22) << np.uint64(22)
        place, first, last = chosen_grams(ids, length - q + 1)
        found.append((ids[place], place + a, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(length: int, q: int):
    """Each task's q-grams: (gram, key of the text, how often it is chosen in it, hot, salt)."""

    def rows(held: list[tuple[np.ndarray, bytes, np.ndarray]]) -> pa.RecordBatch:
        gram = np.concatenate([g for g, _, _ in held])
        keys = np.repeat(np.frombuffer(b"".join(k for _, k, _ in held), dtype="V16"), [len(g) for g, _, _ in held])
        times = np.concatenate([t for _, _, t in held])
        _, code = np.unique(gram, return_inverse=True)
        hot = np.bincount(code, times)[code] >= FREQUENT
        salt = np.where(hot, np.arange(len(gram)) % 64, 0)
        marks = np.unique(gram[hot])  # tell the tasks in which it is rare
        gram, times, hot_all, salt = np.concatenate((gram, marks)), np.concatenate((times, np.full(len(marks), 2))), np.concatenate((hot, np.ones(len(marks), bool))), np.concatenate((salt, np.zeros(len(marks), np.int64)))
        mark = np.concatenate((np.zeros(len(hot), bool), np.ones(len(marks), bool)))
        raw = pa.Array.from_buffers(pa.binary(16), len(gram), [None, pa.py_buffer(keys.tobytes() + bytes(16 * len(marks)))])
        key = pc.if_else(pa.array(mark), pa.scalar(None, pa.binary()), raw.cast(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), key, pa.array(times.astype(np.int64)), pa.array(hot_all), pa.array(np.where(hot_all & ~mark, salt + 1, 0).astype(np.int32))], ["gram", "key", "times", "hot", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, bytes, np.ndarray]] = []
        known: set[bytes] = set()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length or (key := hashlib.md5(data).digest()) in known:
                    continue
                known.add(key)
                held.append((lambda g, n: (g, key, n))(*np.unique(_runs(np.frombuffer(data, np.uint8), length, q)[0], return_counts=True)))
                size += len(held[-1][0])
                if size > HELD:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)
            held.clear()
        release_memory()

    return run


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (salt, gram, key): those whose gram is chosen elsewhere too, with `large`."""
    names = ["key", "gram", "large"]
    carry: pa.Table | None = None
    streamed: int | None = None  # a gram that is too large to hold; its rows pass through

    def close(t: pa.Table, begun: bool = False) -> pa.RecordBatch:
        """Rows of whole groups; of a group that is only begun, all texts, and as large as those to come. Copies of a text count once."""
        gram = t.column("gram").to_numpy()
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(gram))))
        key = t.column("key").combine_chunks()
        real = np.asarray(key.is_valid())
        width = np.frombuffer(b"".join(k or bytes(16) for k in key.to_pylist()), dtype="V16")
        new = np.concatenate(([True], (width[1:] != width[:-1]) | (gram[1:] != gram[:-1])))
        found = np.bincount(group[new & real], t.column("times").to_numpy()[new & real], len(head))
        salted = t.column("salt").to_numpy() > 0
        hot = np.bincount(group, t.column("hot").to_numpy(zero_copy_only=False), len(head)) > 0
        keep = new & real & (begun | salted | ((found > 1) | hot)[group])
        large = (begun | salted | ((found > LARGE) | hot)[group])[keep]
        return pa.RecordBatch.from_arrays([key.filter(pa.array(keep)), pa.array(gram[keep]), pa.array(large)], names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        gram = t.column("gram").to_numpy()
        if streamed is not None:
            n = int(np.argmax(gram != streamed)) if (gram != streamed).any() else len(gram)
            part = t.slice(0, n)
            part = part.filter(part.column("key").is_valid())
            yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), part.column("gram").combine_chunks(), pa.array([True] * len(part), pa.bool_())], names)
            t, gram = t.slice(n), gram[n:]
            if not len(gram):
                continue
            streamed = None
        if carry is not None:
            t = pa.concat_tables([carry, t])
            gram = t.column("gram").to_numpy()
        other = np.flatnonzero(gram != gram[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield close(t.slice(0, cut).combine_chunks())
        carry = t.slice(cut)
        if len(carry) > 4 * LARGE:
            yield close(carry.combine_chunks(), True)
            streamed, carry = int(gram[-1]), None
    if carry is not None and len(carry):
        yield close(carry.combine_chunks())


def _contexts(length: int, q: int):
    """The strings of the runs left of each text, once for equal texts in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for key, text, alive in zip(*(batch.column(c) for c in ("key", "text", "alive")), strict=True):
                key = key.as_py()
                if key == last:
                    continue
                last = key
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                wanted = alive.values.field("gram").to_numpy()
                large = dict(zip(wanted.tolist(), alive.values.field("large").to_pylist(), strict=True))
                gram, place, first, end = _runs(np.frombuffer(data, np.uint8), length, q)
                gram = gram.view(np.int64)
                held: dict[tuple[int, int, bytes], list[int]] = {}
                for i in np.flatnonzero(np.isin(gram, wanted)).tolist():
                    a = int(first[i])
                    held.setdefault((int(gram[i]), int(place[i]) - a, data[a : int(end[i]) + length]), []).append(i)
                known = []
                for (g, offset, string), own in held.items():
                    a = int(first[own[0]])
                    out.append((g, a % 64 + 1 if large[g] else 0, key, a, offset, string))
                    size += len(string)
                    if len(own) > 1:
                        known += [(int(first[i]), int(end[i]) + length) for i in own]
                for a, z in covered(known):  # a span without a string
                    out.append((zlib.crc32(key) ^ a, 0, key, a, z, None))
                if size > CHUNK:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)
        release_memory()

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["gram", "salt", "key", "first", "place", "string"])


def bucket_order(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """All places of `data` with FIRST bytes or more to the end of their string, in an order in which those that agree in `length` bytes lie together.

    ends: of each place the end of its string. The order is that of the first buckets' identifiers, refined by the pointers of later buckets.
    """
    q = min(FIRST, length)
    ids = gram_ids(data, q)
    order = np.flatnonzero(np.arange(len(ids)) + q <= ends[: len(ids)])
    order = order[np.argsort(ids[order])]
    ids = ids[order]
    n = len(data)
    pointer, depth = np.full(n, -1), q

    def point(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Points the members at (sorted) places to the last of their bucket; new: where a bucket begins. Returns the bucket sizes."""
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(new)))
        pointer[order[places]] = np.repeat(places[heads + sizes - 1], sizes)
        return np.repeat(sizes, sizes)

    open_ = np.arange(len(order))  # places of buckets that are still refined
    if len(order):
        open_ = open_[point(open_, np.concatenate(([True], ids[1:] != ids[:-1]))) > 1]
    del ids
    while len(open_) and depth < length:
        member = order[open_]
        offset = min(depth, length - depth)
        target = member + offset
        inside = target + depth <= ends[member]
        target[~inside] = 0
        # Too near to the end: such a place is no start, nor a later offset of one, and stays by itself.
        both = pointer[member] * (2 * n + 1) + np.where(inside, pointer[target], n + member)
        by = np.argsort(both)
        both = both[by]
        order[open_] = member[by]
        open_ = open_[point(open_, np.concatenate(([True], both[1:] != both[:-1]))) > 1]
        depth += offset
    return order


def repeated_starts(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string's number, start in it, whether its `length` bytes start elsewhere too) of all starts of all strings.

    Equal strings are one in the order, and all of their starts repeat.
    """
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(s, len(number)) for s in strings])
    owner, start, again = _repeated_starts(list(number), length)
    often = np.bincount(of) > 1
    again |= often[owner]
    n = np.bincount(owner, minlength=len(number))
    first, n = (np.cumsum(n) - n)[of], n[of]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(strings)), n), at, again[np.repeat(first, n) + at]


def _repeated_starts(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings], dtype=np.int64)
    base = np.cumsum(size) - size
    n = size - length + 1
    owner = np.repeat(np.arange(len(strings)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ends = np.repeat(base + size, size)
    order = bucket_order(data, ends, length)
    order = order[order + length <= ends[order]]
    same = np.zeros(len(data), bool)
    a, b = order[:-1], order[1:]
    # Eight bytes at a time; the last eight overlap where the length is no multiple.
    wide = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,)) if length >= 8 else data
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
        equal = wide[a + at] == wide[b + at]
        a, b = a[equal], b[equal]
    same[a] = same[b] = True
    return owner, start, same[base[owner] + start]


def _refine(length: int, q: int):
    """Spans of repeated strings from rows sorted by (gram, salt); of large buckets, every start with its identifiers."""

    def small(t: pa.Table) -> Iterator[pa.RecordBatch]:
        first, keys = t.column("first").to_numpy(), t.column("key").combine_chunks()
        owner, start, again = repeated_starts(t.column("string").to_pylist(), length)
        at = np.flatnonzero(again)
        if len(at):  # neighbouring starts of a string make a span
            head = np.concatenate(([True], (owner[at[1:]] != owner[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1)))
            a, b = at[head], at[np.append(np.flatnonzero(head)[1:] - 1, len(at) - 1)]
            nothing = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[a])), pa.array(first[owner[a]] + start[a]), pa.array(first[owner[b]] + start[b] + length), nothing, nothing], ["key", "a", "b", "bucket", "other"])

    def large(t: pa.Table) -> Iterator[pa.RecordBatch]:
        first, keys = t.column("first").to_numpy(), t.column("key").combine_chunks()
        for i, string in enumerate(t.column("string").to_pylist()):
            data = np.frombuffer(string, np.uint8)
            one, two = gram_ids(data, length), gram_ids(data, length, _OTHER)
            begin = first[i] + np.arange(len(one))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.full(len(one), i))), pa.array(begin), pa.array(begin + length), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["key", "a", "b", "bucket", "other"])

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        salted = t.column("salt").to_numpy() > 0
        if not salted.all():
            yield from small(t.filter(pa.array(~salted)))
        if salted.any():
            yield from large(t.filter(pa.array(salted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            spans = batch.filter(batch.column("string").is_null())
            if spans.num_rows:
                yield pa.RecordBatch.from_arrays([spans.column("key"), spans.column("first"), spans.column("place"), *[pa.nulls(spans.num_rows, pa.int64())] * 2], ["key", "a", "b", "bucket", "other"])
            batch = batch.filter(batch.column("string").is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            other = np.flatnonzero(gram != gram[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from work(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield from work(pa.Table.from_batches(held))
            held.clear()
        release_memory()

    return run


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of the bytes covered."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of a run that begins and ends between UTF-8 characters."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _cut(columns: list[str], length: int, text_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            removed, n_bytes, n_spans, digest = [], [], [], []
            for text, copies, spans in zip(*(batch.column(c) for c in ("text", "copies", "spans")), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if copies.as_py() and len(data) >= length:
                    runs = [(0, len(data))]
                else:
                    runs = covered([(s["a"], s["b"]) for s in spans.as_py() or ()])
                if text_out:
                    runs = [whole_characters(data, a, b) for a, b in runs]
                left = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)], strict=True))
                if text_out:
                    texts.append(None if text.as_py() is None else left.decode("utf-8", "surrogatepass"))
                n_bytes.append(len(data))
                removed.append(len(data) - len(left))
                n_spans.append(len(runs))
                digest.append(hashlib.sha256(left).hexdigest())
            own = [batch.column(c) for c in columns]
            if text_out:
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], [*columns, "new_text", "n_removed"])
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)], [*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _cover(spark: SparkSession, rows: DataFrame, scratch: Scratch, length: int, q: int) -> DataFrame:
    """rows (_row, text) with what is known of their texts: copies (null: one only) and spans."""
    keyed = rows.withColumn("key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    copies = scratch.store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    grams = rows.select("text").mapInArrow(_anchors(length, q), "gram long, key binary, times long, hot boolean, salt int")
    alive = grams.repartition("salt", "gram").sortWithinPartitions("salt", "gram", "key").mapInArrow(_alive, "key binary, gram long, large boolean")
    alive = scratch.store(alive.groupBy("key").agg(F.collect_list(F.struct("gram", "large")).alias("alive")), "alive")
    strings = keyed.select("key", "text").join(alive.hint("merge"), "key").mapInArrow(_contexts(length, q), "gram long, salt int, key binary, first long, place long, string binary")
    # Copies of a text lie together, but a join may split them: a member counts once.
    found = strings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "key", "first").mapInArrow(_once(_refine(length, q)), "key binary, a long, b long, bucket long, other long")
    found = scratch.store(found, "found")
    scratch.keep("found", "copies")
    spans = found.where("bucket IS NULL").select("key", "a", "b")
    if not found.where("bucket IS NOT NULL").isEmpty():
        large = found.where("bucket IS NOT NULL").distinct()
        again = large.groupBy("bucket", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "other")
        spans = spans.unionByName(large.join(again.hint("merge"), ["bucket", "other"]).select("key", "a", "b"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    known = spans.join(copies, "key", "full")
    return keyed.join(known.hint("merge"), "key", "left")


def _once(work):
    """Drops rows that repeat (gram, key, first) of the row before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def clean() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                marks = list(zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "first")), strict=True))
                keep = [m != b for m, b in zip(marks, [last, *marks[:-1]], strict=True)]
                last = marks[-1] if marks else last
                yield batch if all(keep) else batch.filter(pa.array(keep))

        yield from work(clean())

    return run


def spans(spark: SparkSession, docs: DataFrame, length: int = 200, q: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _cover(spark, rows, Scratch(spark, "repeats"), length, q).select("doc_id", "text", "copies", "spans")
    return found.mapInArrow(_cut(["doc_id"], length, False), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(spark: SparkSession, docs: DataFrame, length: int = 200, q: int = 64, text_col: str = "text", drop_empty: bool = False) -> DataFrame:
    """The rows with their texts cut; with drop_empty, without those that lose all of their text."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    found = _cover(spark, rows, Scratch(spark, "repeats"), length, q).select("_row", "text", "copies", "spans")
    schema = found.select("_row").schema.add("new_text", "string").add("n_removed", "long")
    cut = found.mapInArrow(_cut(["_row"], length, True), schema)
    if drop_empty:
        cut = cut.where("NOT (n_removed > 0 AND new_text = '')")
    return cut.select(*[F.col("new_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
