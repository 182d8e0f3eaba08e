"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one point, which carries the smallest `k + 1` identifiers of its copies: no more of them can be
among a query's `k` nearest, since ties go to smaller identifiers. Points are dealt to shards of about `shard_points` by
hash, a task each. A task builds the graph of its shard (flat neighbour arrays, one per level, -1 where a place is
empty) and reads the different query vectors from the shared folder in blocks. Of what a search finds, a shard returns
the `k + 1` nearest and all that are as near within the error of 4-byte sums (ERROR). These are scored again in
double precision on the original vectors, once for each pair of different vectors, and the best of all shards are kept.

Vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate. A query is not
its own candidate, by identifier; rows that repeat an identifier count as copies of it and as one query for each
different vector, of which the best results are kept. Equal scores are ordered by identifier. Vectors of different
length are never compared. With fewer candidates than `k` all are returned. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, release_memory

BATCH = 512
#: Most that a cosine by 4-byte sums may be off.
ERROR = 1e-5


@dataclass
class Graph:
    vectors: np.ndarray  # unit length, float32
    levels: list[np.ndarray]  # of each level: points x degree, -1 if empty; level 0 first
    members: list[np.ndarray]  # of each level above 0: the points in it
    entry: int


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once: their nearest points found (-1: none) and similarities, best first."""
    n = len(queries)
    ids = np.full((n, width), -1, dtype=np.int64)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    first = start.reshape(n, -1)[:, :width]
    got = np.einsum("nd,nkd->nk", queries, vectors[first])
    order = np.argsort(-got, axis=1, kind="stable")
    ids[:, : first.shape[1]], sims[:, : first.shape[1]] = np.take_along_axis(first, order, 1), np.take_along_axis(got, order, 1)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        pick = np.argmax(~done[live], axis=1)  # the best that isn't expanded yet
        at = ids[live, pick]
        done[live, pick] = True
        near = links[at].astype(np.int64)
        new = near >= 0
        new &= ~(near[:, :, None] == ids[live][:, None, :]).any(2)
        got = np.einsum("nd,nkd->nk", queries[live], vectors[np.maximum(near, 0)])
        got[~new] = -np.inf
        all_ids, all_sims = np.concatenate((ids[live], np.where(new, near, -1)), 1), np.concatenate((sims[live], got), 1)
        all_done = np.concatenate((done[live], ~new), 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_done))
        live = live[~done[live].all(1)]
    return ids, sims


def _spread(vectors: np.ndarray, point: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each point's candidates (best first) the neighbours kept: those nearer to it than to any kept before; then the best others."""
    n, width = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = np.einsum("nkd,njd->nkj", own, own)
    kept = np.zeros((n, width), dtype=bool)
    valid = ids >= 0
    for i in range(width):
        closest = np.where(kept, between[:, i, :], -np.inf).max(1)
        kept[:, i] = valid[:, i] & (closest < sims[:, i]) & (kept.sum(1) < degree)
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :degree]
    return np.take_along_axis(np.where(valid, ids, -1), order, 1)


def _insert(vectors: np.ndarray, links: np.ndarray, points: np.ndarray, start: np.ndarray, width: int, degree: int) -> np.ndarray:
    """Links `points` into a level, both ways; returns each point's nearest found."""
    ids, sims = _beam(vectors, links, vectors[points], start, width)
    chosen = _spread(vectors, points, ids, sims, degree // 2)
    links[points, : chosen.shape[1]] = chosen
    to, back = chosen.ravel(), np.repeat(points, chosen.shape[1])
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    heads, at, n = np.unique(to, return_index=True, return_counts=True)
    for size in np.unique(n):  # targets with equally many new links at a time
        of, begin = heads[n == size], at[n == size]
        both = np.concatenate((links[of].astype(np.int64), back[begin[:, None] + np.arange(size)]), 1)
        near = np.einsum("nd,nkd->nk", vectors[of], vectors[np.maximum(both, 0)])
        near[both < 0] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")[:, : 2 * degree]
        both, near = np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1)
        full = (both >= 0).sum(1) > degree
        kept = both[:, :degree].copy() if both.shape[1] >= degree else np.pad(both, ((0, 0), (0, degree - both.shape[1])), constant_values=-1)
        if full.any():
            kept[full] = _spread(vectors, of[full], both[full], near[full], degree)
        links[of] = kept
    return ids


def build(vectors: np.ndarray, degree: int = 16, width: int = 48, seed: int = 7) -> Graph:
    """The graph of unit vectors. Points enter in random order, in batches no larger than a part of what is there."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 12)
    order = np.lexsort((rng.permutation(n), -level))  # higher points first: an upper level is whole before it is used
    top = int(level.max(initial=0))
    links = [np.full((n, degree if i else 2 * degree), -1, dtype=np.int32) for i in range(top + 1)]
    entry = int(order[0]) if n else -1
    members: list[np.ndarray] = []
    for i in range(top, -1, -1):
        mine = order[level[order] >= i]
        inside = 1
        while inside < len(mine):
            batch = mine[inside : inside + min(BATCH, max(1, inside // 2))]
            start = np.full(len(batch), entry)
            for j in range(top, i, -1):
                start = _beam(vectors, links[j], vectors[batch], start, 1)[0][:, 0]
            start = np.where(level[batch] > i, entry, start)  # a point of an upper level would find itself, not yet linked here
            _insert(vectors, links[i], batch, start, width, links[i].shape[1])
            inside += len(batch)
        if i:
            members.insert(0, mine)
    return Graph(vectors, links, members, entry)


def search(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of up to `width` nearest points of each query."""
    start = np.full(len(queries), graph.entry)
    for links in graph.levels[:0:-1]:
        start = _beam(graph.vectors, links, queries, start, 1)[0][:, 0]
    return _beam(graph.vectors, graph.levels[0], queries, start, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(np.float64).tiny)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1).astype(np.float64)


def _blocks(uri: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, points, vectors) of the query vectors in the shared folder."""
    where, folder = fs.FileSystem.from_uri(uri)
    for info in sorted(where.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as file:
                for block in pq.ParquetFile(file).iter_batches(batch_size=BATCH, columns=["dim", "point", "vector"]):
                    dims = block.column("dim").to_numpy()
                    for dim in np.unique(dims).tolist():
                        part = block.filter(pa.array(dims == dim))
                        yield dim, part.column("point").to_numpy(), _matrix(part.column("vector"))


def _search_shard(uri: str, found: int, width: int):
    """Pairs of query point and point from the points of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        points = pa.Table.from_batches(held).sort_by("point")
        held.clear()
        graphs = {}
        for dim in np.unique(points.column("dim").to_numpy()).tolist():
            part = points.filter(pa.array(points.column("dim").to_numpy() == dim))
            graphs[dim] = part.column("point").to_numpy(), build(_unit(_matrix(part.column("vector").combine_chunks())))
        del points
        for dim, asked, vectors in _blocks(uri):
            if dim not in graphs:
                continue
            ids, graph = graphs[dim]
            got, near = search(graph, _unit(vectors), width)
            last = near[:, min(found, near.shape[1]) - 1][:, None]
            keep = (got >= 0) & (near >= np.where(np.isfinite(last), last - 2 * ERROR, -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, keep.sum(1))), pa.array(ids[got[keep]])], ["query_point", "point"])
        release_memory()

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x, y = (_matrix(part.column(c)) for c in "ab")
            x, y = (v / (2.0 ** np.floor(np.log2(np.abs(v).max(1, keepdims=True)))) for v in (x, y))  # exact, keeps squares in range
            score = np.einsum("nd,nd->n", x, y) / (np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y)))
            yield pa.RecordBatch.from_arrays([part.column("query_point"), part.column("copies"), pa.array(score)], ["query_point", "copies", "score"])


def nearest(spark: SparkSession, vectors: DataFrame, query_mod: int = 50, k: int = 5, width: int = 200, shard_points: int = 32_768, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Queries: identifiers divisible by `query_mod`; candidates: all other rows."""
    scratch = Scratch(spark, "nearest")
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False))).withColumn("asks", F.col("vec_id") % query_mod == 0)
    # A point for each different vector. Copies are kept as the k + 1 smallest identifiers; sets of that size merge before the shuffle.
    smallest = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    part = rows.groupBy("vector", bucket_of(F.col("vec_id"), buckets=64).alias("salt")).agg(smallest.alias("copies"), F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    points = part.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("copies")))), 1, k + 1).alias("copies"), F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    points = scratch.store(points.select(F.xxhash64(F.element_at("copies", 1), "vector").alias("point"), F.size("vector").alias("dim"), "vector", "copies", "n", "asked"), "points")
    counts = points.agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("rows")).first()
    if not counts["points"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(6, -(-counts["points"] // shard_points))
    scratch.store(points.where("asked > 0").select("dim", "point", "vector"), "queries")
    dealt = points.select(bucket_of(F.col("point"), buckets=shards).alias("shard"), "dim", "point", "vector").repartitionById(shards, F.col("shard"))
    pairs = scratch.store(dealt.mapInArrow(_search_shard(scratch.sub("queries"), k + 1, width), "query_point long, point long"), "pairs")
    near = pairs.join(points.select("point", "copies", F.col("vector").alias("b")), "point").join(points.select(F.col("point").alias("query_point"), "dim", F.col("vector").alias("a")), "query_point")
    scored = near.select("query_point", "dim", "copies", "a", "b").mapInArrow(_score, "query_point long, copies array<long>, score double")
    single = scored.select("query_point", F.explode("copies").alias("vec_id"), "score").groupBy("query_point", "vec_id").agg(F.max("score").alias("score"))
    # The best k + 1 of a query vector: one of them may be the query itself.
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.col("score").desc(), "vec_id"))
    best = single.withColumn("rank", rank("query_point")).where(F.col("rank") <= k + 1)
    best = scratch.store(best.groupBy("query_point").agg(F.collect_list(F.struct("vec_id", "score")).alias("found")), "best")
    scratch.keep("points", "best")
    # Vectors of over a thousandth of the rows, a thousand of them at most, are joined by broadcast; no other key is hot.
    hot = F.col("n") * 1000 > counts["rows"]
    known = points.where("asked > 0").select("point", "vector", hot.alias("hot")).join(best, F.col("point") == F.col("query_point")).select("vector", "hot", "found")
    ours = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector")
    ours = ours.join(F.broadcast(known.where("hot").select("vector", F.col("found").alias("often"))), "vector", "left")
    answers = ours.where("often IS NOT NULL").select("query_id", F.col("often").alias("found"))
    answers = answers.unionByName(ours.where("often IS NULL").join(known.where("NOT hot").select("vector", "found"), "vector").select("query_id", "found"))
    out = answers.select("query_id", F.explode("found").alias("x")).select("query_id", "x.*").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return out.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
