"""Source divergence audit: hash-consed segment trees of term counts, traversed two at a time.

The kept terms of a language are dealt into blocks by hash, and a block numbers its terms. The counts of one source over the
numbers of a block are the leaves of a segment tree. All trees of a task share their nodes: equal subtrees of counts are one
node. A pair of sources is priced by walking both trees at once, from the roots down; equal pairs of nodes are met once
and carry how often they occur, so the work follows the different pairs of nodes rather than the terms.

A task gets one block of one pair of tiles of sources: `BLOCK` terms and `TILE` sources at either side, however many
documents, terms or sources there are. Prices of blocks are added up by Spark.

Null text, lang and source count as ''. Repeated rows count each. Sources of equal value are ranked by their UTF-8 name.
A language without kept terms has pairs of value 0 and no term rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, ranked, release_memory
from .words import slices

#: Terms of a block on average; sources of a tile.
BLOCK, TILE = 4096, 32
#: Parts of 1 in which shares are counted; what is added to each count.
UNIT, PRIOR = 1_000_000_000, 2
#: Lower-cases A-Z; all other ASCII bytes but letters part terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts and the text each is of."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = b"".join((t or "").encode() for t in texts.to_pylist()).translate(LETTERS)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(whole))
    split = pc.ascii_split_whitespace(plain)
    terms, owner = split.flatten(), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(full).dictionary_encode(), owner.filter(full).to_numpy()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of texts and each group in it: terms with their occurrences and the number of documents that have them."""
    for batch in batches:
        for a, b in slices(batch["text"], 8 << 20):
            terms, owner = _split(batch["text"].slice(a, b - a))
            words = terms.dictionary
            if not len(terms):
                continue
            code = terms.indices.to_numpy().astype(np.int64)
            names = pa.StructArray.from_arrays([batch[c].slice(a, b - a) for c in ("lang", "source")], ["lang", "source"])
            groups = {}
            group = np.fromiter((groups.setdefault((x["lang"], x["source"]), len(groups)) for x in names.to_pylist()), np.int64, b - a)
            each, n = np.unique(owner * len(words) + code, return_counts=True)  # a document's terms
            key, at = np.unique(group[each // len(words)] * len(words) + each % len(words), return_inverse=True)
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            own, term = pa.array(key // len(words)), pa.array(key % len(words))
            count, docs = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
            yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), words.take(term).cast(pa.string()), pa.array(count), pa.array(docs)], names=["lang", "source", "term", "count", "docs"])
        release_memory()


def share(count: str, whole: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / whole), exactly."""
    return F.expr(f"1 + cast({UNIT} AS decimal(10,0)) * cast({count} + {PRIOR} AS decimal(20,0)) div cast({whole} AS decimal(20,0))")


def _share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays: long division by thousands, exact for totals under 9e15."""
    told, rest = np.divmod(count + PRIOR, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        told = told * 1000 + digit
    return told + 1


class Trees:
    """Segment trees over one range of terms that share equal subtrees. `levels[0]` has the leaves' counts, `levels[k]` pairs of nodes of the level below."""

    def __init__(self, counts: np.ndarray):
        """`counts`: a row of counts for each tree."""
        trees, terms = counts.shape
        self.levels: list[np.ndarray] = []
        width = 1 << max(0, int(terms - 1).bit_length())
        leaves = np.full((trees, width), -1, np.int64)  # places beyond the terms
        leaves[:, :terms] = counts
        values, nodes = np.unique(leaves, return_inverse=True)
        self.levels.append(values)
        nodes = nodes.reshape(trees, width)
        while nodes.shape[1] > 1:
            pairs = nodes[:, ::2] * len(self.levels[-1]) + nodes[:, 1::2]
            whole, found = np.unique(pairs, return_inverse=True)
            self.levels.append(np.stack(np.divmod(whole, len(self.levels[-1])), axis=1))
            nodes = found.reshape(pairs.shape)
        self.roots = nodes[:, 0]

    def prices(self, a: np.ndarray, b: np.ndarray, whole_a: np.ndarray, whole_b: np.ndarray) -> np.ndarray:
        """The sum over terms of floor((p - q)^2 / (p + q)) for each pair of trees a[i], b[i] with these totals."""
        pair, left, right, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            below, size = self.levels[level], len(self.levels[level - 1])
            pair = np.concatenate((pair, pair))
            key = (pair * size + np.concatenate((below[left, 0], below[left, 1]))) * size + np.concatenate((below[right, 0], below[right, 1]))
            key, at = np.unique(key, return_inverse=True)
            times = np.bincount(at, np.concatenate((times, times)), len(key)).astype(np.int64)
            key, right = np.divmod(key, size)
            pair, left = np.divmod(key, size)
        x, y = self.levels[0][left], self.levels[0][right]
        real = x >= 0
        pair, x, y, times = pair[real], x[real], y[real], times[real]
        p, q = _share(x, whole_a[pair]), _share(y, whole_b[pair])
        out = np.zeros(len(a), np.int64)
        np.add.at(out, pair, times * ((p - q) * (p - q) // (p + q)))
        return out


_PRICED = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of one pair of tiles: the row without a term has the sources, the others counts."""
    lang, _, first, second = (k.as_py() for k in key)
    head = rows.filter(pc.is_null(rows["term"]))
    roster = {r["id"]: r["whole"] for r in head["roster"][0].as_py()}
    told = rows.filter(pc.is_valid(rows["term"]))
    ids = sorted(roster)
    places = np.searchsorted(np.asarray(ids), told["id"].to_numpy())
    code = told["term"].combine_chunks().dictionary_encode()
    # terms seen in the tiles are numbered by how often they occur, so that rare ones lie together; then those of other sources
    seen = len(code.dictionary)
    sums = np.bincount(code.indices.to_numpy(), told["count"].to_numpy(), seen)
    number = np.empty(seen, np.int64)
    number[np.lexsort((np.asarray(code.dictionary.to_pylist(), object), -sums))] = np.arange(seen)
    counts = np.zeros((len(ids), head["terms"][0].as_py()), np.int64)
    counts[places, number[code.indices.to_numpy()]] = told["count"].to_numpy()
    wholes = np.asarray([roster[i] for i in ids], np.int64)
    tile = np.asarray(ids) // TILE
    a, b = np.nonzero((tile[:, None] == first) & (tile[None, :] == second) & (np.asarray(ids)[:, None] < np.asarray(ids)[None, :]))
    value = Trees(counts).prices(a, b, wholes[a], wholes[b]) if counts.shape[1] and len(a) else np.zeros(len(a), np.int64)
    own = np.asarray(ids, np.int64)
    return pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(own[a]), pa.array(own[b]), pa.array(value)], schema=_PRICED)


def audit(spark: SparkSession, docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """How each source of a language differs from its other sources (part `pair`) and in which terms it stands out most (part `term`).

    Terms that fewer than `least` documents of a language have are left out; `top` bounds the ranks of part `term`.
    """
    scratch = Scratch(spark, "divergence")
    told = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    schema = "lang string, source string, term string, count long, docs long"
    counts = told.mapInArrow(_counted, schema).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counts = scratch.store(counts, "all-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= least).select("lang", "term", "all")
    kept = scratch.store(kept, "kept")
    counts = scratch.store(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "all"), "counts")
    scratch.drop("all-counts")

    # a row for each language; totals fit a long, shares are divided as decimals
    langs = told.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("sum")), "lang", "left")
    langs = langs.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), (F.coalesce("sum", F.lit(0)) + PRIOR * F.coalesce("terms", F.lit(0))).alias("lang_whole"))
    groups = told.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("count").alias("sum")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang").select("lang", "source", "terms", "lang_whole", (F.coalesce("sum", F.lit(0)) + PRIOR * F.col("terms")).alias("whole"))
    groups = scratch.store(ranked(groups, ["lang"], ["source"], ["source"], 64, "id"), "groups")

    q, p = share("all", "lang_whole"), share("count", "whole")
    terms = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    # cells: each block of a language with each two tiles of its sources; a count goes to all cells of its tile
    tile = F.floor(F.col("id") / TILE)
    tiles = groups.groupBy("lang", tile.alias("tile")).agg(F.collect_list(F.struct("id", "whole")).alias("roster"))
    sizes = groups.groupBy("lang").agg((F.floor(F.max("id") / TILE) + 1).alias("tiles"), F.first("terms").alias("terms"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK))
    sizes = sizes.select("lang", "tiles", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    each = kept.join(sizes, "lang").select("lang", "term", block)
    filled = each.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    every = sizes.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    filled = every.join(filled, ["lang", "block"], "left").select("lang", "block", F.coalesce("terms", F.lit(0)).alias("terms"))
    one = tiles.select("lang", F.col("tile").alias("first"), F.col("roster").alias("left"))
    two = tiles.select("lang", F.col("tile").alias("second"), F.col("roster").alias("right"))
    none = {c: F.lit(None).cast(t) for c, t in (("term", "string"), ("id", "long"), ("count", "long"))}
    heads = one.join(two, "lang").where("first <= second").join(filled, "lang")
    roster = F.when(F.col("first") == F.col("second"), F.col("left")).otherwise(F.concat("left", "right"))
    heads = heads.select("lang", "block", "first", "second", *[c.alias(n) for n, c in none.items()], roster.alias("roster"), "terms")
    entries = counts.join(groups.select("lang", "source", "id"), ["lang", "source"]).join(sizes, "lang")
    entries = entries.select("lang", block, tile.alias("_tile"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("_other"), "term", "id", "count")
    entries = entries.select("lang", "block", F.least("_tile", "_other").alias("first"), F.greatest("_tile", "_other").alias("second"), "term", "id", "count", F.lit(None).cast(heads.schema["roster"].dataType).alias("roster"), F.lit(None).cast("long").alias("terms"))
    priced = heads.unionByName(entries).groupBy("lang", "block", "first", "second").applyInArrow(_cell, "lang string, a long, b long, value long")
    priced = scratch.store(priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "prices")
    both = priced.unionByName(priced.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "id", "source")
    pairs = both.join(names.withColumnsRenamed({"id": "a"}), ["lang", "a"]).join(names.withColumnsRenamed({"id": "b", "source": "item"}), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.unionByName(pairs.withColumn("rank", F.row_number().over(order)))
