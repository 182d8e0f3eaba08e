"""Near-duplicate documents by a signature-coordinate inverted join of MinHash signatures.

Two documents are linked if the Jaccard similarity of their word-shingle sets is at least `percent` / 100; groups are
the connected components of the links.

1.  Equal sets are one class with one signature of COORDINATES minima. `matches(percent)` is the least number of
    coordinates in which a pair must agree: as many as a pair of just that similarity has but for a chance of MISSED.
2.  Prefix: two signatures that agree in so many coordinates agree in at least one of the first
    COORDINATES - matches + 1, whichever these are. Classes are posted under each of these coordinate-value pairs.
    Each posting carries a byte of every coordinate.
3.  Skip: inside a posting list, agreements are counted over the carried bytes alone, without reading the other lists.
    Of the pairs with enough of them, a list returns one edge for each class it joins to another, not all pairs. Lists
    over LONG postings are posted again, under their pair and each of the other coordinates of the next prefix, which
    loses no pair and splits what only one frequent shingle has brought together.
4.  The edges' components hold all candidate pairs. Their full sets are compared: pairs in falling order of agreements,
    leaving out pairs already joined, until all pairs that could be linked are joined or refuted. A component goes to
    tasks in blocks of about BLOCK classes, each with the component's first class; where these joined all blocks, that
    is all. Only components left in several groups are then compared block by block, every block with every other, and
    there only classes of different groups, so no task holds more than two blocks.

What is linked is confirmed on full sets. A pair is missed only by its signatures, with a chance of MISSED (1 in
100,000) at the similarity of `percent` itself and less above; a group is cut only where all pairs between its parts are missed.

Null and empty texts and texts without words have no shingles and no links. Repeated rows are copies. A null
identifier gives no component identifier to its group. Ties don't arise. Very long texts have large sets, held whole.
An empty table gives no rows. Other columns, whatever their names, are ignored by `cluster` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .words import mix, shingles, slices

COORDINATES, MISSED = 48, 1e-5
#: Postings beyond which a list is posted again by a second coordinate; classes of a block.
LONG, BLOCK = 20_000, 256
_RANDOM = np.random.default_rng(5)
_A = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64, endpoint=False) | np.uint64(1)
_B = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64, endpoint=False)


def matches(percent: int) -> int:
    """The most agreements that a pair of this similarity reaches but for a chance of MISSED, by the binomial distribution; at least 1."""
    p, chance = percent / 100, 0.0
    for t in range(COORDINATES):
        chance += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if chance > MISSED:
            return max(1, t)
    return COORDINATES


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minima of each set (documents x COORDINATES, 32 bits); of empty sets the largest value."""
    out = np.full((len(at) - 1, COORDINATES), 2**32 - 1, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i in range(COORDINATES):
            out[full, i] = np.minimum.reduceat(((sets * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), at[full])
    return out


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets, at = shingles(part.column("text"), k)
                sig = signatures(sets, at)
                key = [hashlib.md5(sets[x:y].tobytes()).digest() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(np.diff(at).astype(np.int64)), part.column("text_key"), pa.array(key, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "row", "n_shingles", "text_key", "set_key", "signature"])

    return run


def _slots(sig: np.ndarray, coordinates: range, under: np.ndarray | None = None) -> np.ndarray:
    i = np.arange(coordinates.start, coordinates.stop, dtype=np.uint64)
    x = mix((sig[:, coordinates.start : coordinates.stop].astype(np.uint64) << np.uint64(8)) | i)
    return x if under is None else mix(x ^ under[:, None])


def _post(prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            short = [r.tobytes() for r in sig.astype(np.uint8)]
            slot = _slots(sig, range(prefix)).view(np.int64)
            of = np.repeat(np.arange(len(sig)), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), batch.column("class").take(pa.array(of)), pa.array(np.tile(np.arange(prefix, dtype=np.int32), len(sig))), pa.array(short, pa.binary()).take(pa.array(of))], ["slot", "class", "coordinate", "short"])

    return run


def _post_again(prefix: int):
    """A posting of a long list, under its slot and each coordinate of the next prefix (all but one of the matches are among the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = np.frombuffer(b"".join(batch.column("short").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            own, slot = batch.column("coordinate").to_numpy(), batch.column("slot").to_numpy().view(np.uint64)
            # The others in order, their own coordinate left out.
            other = np.arange(min(prefix, COORDINATES - 1))[None, :]
            other = other + (other >= own[:, None])
            value = np.take_along_axis(short, other, 1).astype(np.uint64)
            again = mix(mix((value << np.uint64(8)) | other.astype(np.uint64)) ^ slot[:, None]).view(np.int64)
            of = pa.array(np.repeat(np.arange(len(short)), other.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(again.ravel()), *(batch.column(c).take(of) for c in ("class", "coordinate", "short"))], ["slot", "class", "coordinate", "short"])

    return run


def joined(short: np.ndarray, least: int) -> np.ndarray:
    """Component labels (smallest row) of rows that agree in `least` places or more, found by search from row to row."""
    label = np.full(len(short), -1)
    left = np.arange(len(short))
    for seed in range(len(short)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left = left[left > seed]
        left = left[label[left] < 0]
        todo = [seed]
        while todo and len(left):
            hit = (short[left] == short[todo.pop()]).sum(1) >= least
            if hit.any():
                label[left[hit]] = seed
                todo += left[hit].tolist()
                left = left[~hit]
    return label


def _groups(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values of a column, of about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        t = pa.Table.from_batches(held)
        v = t.column(column).to_numpy()
        other = np.flatnonzero(v != v[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
        size = sum(b.nbytes for b in held)
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t


def _merge(least: int):
    """Edges of each posting list; rows come sorted by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "slot", 8 << 20):
            slot, node = t.column("slot").to_numpy(), t.column("class").to_numpy()
            short = np.frombuffer(b"".join(t.column("short").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            head = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            size = np.diff(np.append(head, len(slot)))
            a_out, b_out = [], []
            two = head[size == 2]
            hit = two[(short[two] == short[two + 1]).sum(1) >= least]
            a_out.append(node[hit])
            b_out.append(node[hit + 1])
            for h, n in zip(head[size > 2], size[size > 2], strict=True):
                label = joined(short[h : h + n], least)
                more = np.flatnonzero(label != np.arange(n))
                a_out.append(node[h + label[more]])
                b_out.append(node[h + more])
            a, b = np.concatenate(a_out), np.concatenate(b_out)
            pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].astype(np.int64)), pa.array(pair[1].astype(np.int64))], ["a", "b"])

    return run


def _sets(k: int):
    """The full sets of texts, once for equal texts in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            keep = [x != y for x, y in zip(keys, [last, *keys[:-1]], strict=True)]
            last = keys[-1] if keys else last
            batch = batch.filter(pa.array(keep, pa.bool_()))
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets, at = shingles(part.column("text"), k)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cluster", "blocks", "class")), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([sets[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["cluster", "blocks", "class", "short", "set"])

    return run


def linked(short: np.ndarray, sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels of exact links among sets, testing pairs with enough agreements that aren't joined yet; label: what is joined to begin with."""
    n, least = len(sets), matches(percent)
    label = np.arange(n) if label is None else label.copy()
    size = np.array([len(s) for s in sets], dtype=np.int64)
    first, second, score = [], [], []
    for i in range(n - 1):
        near = np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))) + i + 1
        agree = (short[near] == short[i]).sum(1)
        near, agree = near[agree >= least], agree[agree >= least]
        first.append(np.full(len(near), i, np.int32))
        second.append(near.astype(np.int32))
        score.append(agree.astype(np.uint8))
    if not first:
        return label
    a, b, s = np.concatenate(first), np.concatenate(second), np.concatenate(score)
    order = np.argsort(-s.astype(np.int16), kind="stable")
    a, b = a[order], b[order]
    at, step = 0, 256
    while at < len(a):
        x, y = a[at : at + step], b[at : at + step]
        at, step = at + step, min(2 * step, 65_536)
        open_ = label[x] != label[y]
        for i, j in zip(x[open_].tolist(), y[open_].tolist(), strict=True):
            if label[i] == label[j]:
                continue
            p, q = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            where = np.searchsorted(q, p)
            where[where == len(q)] = 0
            both = int((q[where] == p).sum())
            if 100 * both >= percent * (size[i] + size[j] - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label[label == old] = new
    return label


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "task", 32 << 20):
            task, node, group = (t.column(c).to_numpy() for c in ("task", "class", "group"))
            short = np.frombuffer(b"".join(t.column("short").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
            head = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
            a_out, b_out = [], []
            for h, e in zip(head, [*head[1:], len(task)], strict=True):
                order = h + np.unique(node[h:e], return_index=True)[1]  # a class that came twice counts once
                _, first, code = np.unique(group[order], return_index=True, return_inverse=True)
                known = first[code]
                label = linked(short[order], [sets[i] for i in order], percent, known)
                more = np.flatnonzero(label != known)
                a_out.append(node[order[label[more]]])
                b_out.append(node[order[more]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out).astype(np.int64)), pa.array(np.concatenate(b_out).astype(np.int64))], ["a", "b"])

    return run


def _grouped(spark: SparkSession, scratch: Scratch, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of doc_id, row and text: the rows described, the classes of equal sets, and the groups of linked classes (node, label)."""
    kind = dict(docs.dtypes)["doc_id"]
    # A null text has an empty key, which no text has.
    texts = docs.withColumn("text_key", F.when(F.col("text").isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.md5(F.col("text").cast("binary")))))
    rows = scratch.store(texts.select("doc_id", "row", "text", "text_key").mapInArrow(_describe(k), f"doc_id {kind}, row long, n_shingles long, text_key binary, set_key binary, signature binary"), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least"), F.min(first).alias("first"), F.min_by(F.struct("signature", "text_key"), "text_key").alias("x"))
    classes = scratch.store(classes.select(F.monotonically_increasing_id().alias("class"), "set_key", "members", "least", "first", "x.signature", "x.text_key"), "classes")
    posted = "slot long, class long, coordinate int, short binary"
    least = matches(percent)
    prefix = COORDINATES - least + 1
    posts = classes.select("class", "signature").mapInArrow(_post(prefix), posted)
    long_lists = scratch.store(posts.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).select("slot"), "long")
    if not long_lists.isEmpty():
        again = posts.join(long_lists, "slot").select("slot", "class", "coordinate", "short").mapInArrow(_post_again(prefix), posted)
        posts = posts.join(long_lists, "slot", "left_anti").select("slot", "class", "coordinate", "short").unionByName(again)
    edges = posts.select("slot", "class", "short").repartition("slot").sortWithinPartitions("slot").mapInArrow(_merge(least), "a long, b long")
    near = components(edges, scratch, "coarse")
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = near.join(sizes, "label").select(F.col("node").alias("class"), F.col("label").alias("cluster"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = members.join(classes.select("class", "signature", "text_key"), "class").select("cluster", "blocks", "class", "signature", "text_key")
    texts_of = texts.select("text_key", "text").join(members.hint("merge"), "text_key").select("text_key", "text", "cluster", "blocks", "class", "signature")
    full = scratch.store(texts_of.mapInArrow(_sets(k), "cluster long, blocks int, class long, short binary, set binary"), "sets")

    def confirmed(tasks: DataFrame) -> DataFrame:
        return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_confirm(percent), "a long, b long")

    # Each block with the cluster's first class (its label).
    block, every = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = full.select("*", F.explode(F.when(F.col("class") == F.col("cluster"), every).otherwise(F.array(block))).alias("block"))
    links = scratch.store(confirmed(dealt.select(F.xxhash64("cluster", "block").alias("task"), "class", F.col("class").alias("group"), "short", "set")), "links")
    groups = components(links, scratch, "exact")
    # Clusters of several blocks that aren't one group yet: a task for each pair of blocks; a class goes to those that hold its block.
    of = members.where("blocks > 1").select("cluster", "class").join(groups.withColumnRenamed("node", "class"), "class", "left").select("cluster", "class", F.coalesce("label", "class").alias("group"))
    left = scratch.store(of.groupBy("cluster").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("cluster"), "left")
    if left.isEmpty():
        scratch.drop("sets", "links", "left", "long")
        return rows, classes, groups
    open_ = full.join(of.join(left, "cluster").select("class", "group"), "class")
    pairs = F.transform(every, lambda other: F.xxhash64(F.col("cluster"), F.least(block, other), F.greatest(block, other)))
    more = confirmed(open_.select(F.explode(pairs).alias("task"), "class", "group", "short", "set"))
    whole = components(links.unionByName(more), scratch, "whole")
    scratch.drop("sets", "links", "left", "long")
    return rows, classes, whole


def cluster(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept (doc_id = component_id) of every document."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col(text_col).alias("text"))
    rows, classes, groups = _grouped(spark, Scratch(spark, "near"), named, k, percent)
    # The smallest document of each group, by its classes.
    grouped = classes.select("class", "set_key", "least").join(groups.withColumnRenamed("node", "class"), "class")
    least = grouped.groupBy("label").agg(F.min("least").alias("group_least"))
    of_class = grouped.join(least, "label").select("set_key", F.col("group_least"))
    of_class = classes.select("set_key", "members", "least").join(of_class, "set_key", "left").select("set_key", "members", F.coalesce("group_least", "least").alias("component_id"))
    # Sets of over a thousandth of the rows, a thousand of them at most, are joined by broadcast; no other key is hot.
    total = rows.count()
    hot = of_class.where(F.col("members") * 1000 > total).select("set_key", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = rows.select("doc_id", "n_shingles", "set_key").join(F.broadcast(hot), "set_key", "left")
    cold = of_class.where(F.col("members") * 1000 <= total).select("set_key", "component_id")
    out = marked.where("hot").select("doc_id", "n_shingles", F.col("hot_id").alias("component_id"))
    out = out.unionByName(marked.where("hot IS NULL AND n_shingles > 0").join(cold, "set_key").select("doc_id", "n_shingles", "component_id"))
    out = out.unionByName(marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` of which one of each group stays: that of the smallest doc_id, one without an id only if none has one.

    Rows are told apart by a key of their own, so null and repeated ids don't tie rows together. Rows without words have
    no links and stay, but of those that repeat an id and its text one stays.
    """
    scratch = Scratch(spark, "kept")
    held = scratch.store(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct("*").alias("_row")), "input")
    named = held.select(F.col("_row")[id_col].alias("doc_id"), F.col("_key").alias("row"), F.col("_row")[text_col].alias("text"))
    rows, classes, groups = _grouped(spark, scratch, named, k, percent)
    of = classes.select("class", "first").join(groups.withColumnRenamed("node", "class"), "class", "left")
    stay = of.groupBy(F.coalesce("label", "class").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("_key"))
    wordless = rows.where("n_shingles = 0")
    stay = stay.unionByName(wordless.where("doc_id IS NULL").select(F.col("row").alias("_key")))
    stay = stay.unionByName(wordless.where("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.min("row").alias("_key")).select("_key"))
    stay = scratch.store(stay, "stay")
    scratch.keep("input", "stay")
    return held.join(stay, "_key").select("_row.*")
