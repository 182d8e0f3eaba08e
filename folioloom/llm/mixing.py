"""Mixing sources to target weights by Pfair scheduling, every document once.

Documents of a source are put in an order by a hash of their identifier and cut into blocks. With weights w that sum to
1, block j (from 0) of a source is released at slot floor(j / w) and is due by slot ceil((j + 1) / w), both by whole
numbers, from the weight itself. At each slot the earliest deadline among the blocks released goes first (ties by the
source's name). On one line of slots that meets every deadline, so after t slots a source of B blocks has put in
min(w t, B) of them to within less than one: exactly the target while it lasts. A source that has run out releases
nothing more; slots at which no block is released stay empty, and the others keep to their windows, so the law holds to
the end. `position` closes the gaps.

The plan is made on the driver from the sources' counts alone. It has a row for each block, MOST_BLOCKS and one for each
source at most: blocks are of `block_rows` rows, by default LEAST_ROWS or as many more as that bound takes.

A null source is a source of its own. Sources without a weight above 0 follow after all others, by name. Null
identifiers and repeated rows are placed like other rows; very long texts are rows like others. An empty table gives no
rows. Other columns, whatever their names, are kept by `mix` and ignored by `schedule`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked

#: Rows of a block, at least; blocks of a plan, at most (besides one for each source).
LEAST_ROWS, MOST_BLOCKS = 64, 1 << 20
#: Sources that a plan can have: beyond, an error is raised, since the driver plans from a row for each.
MOST_SOURCES = 1 << 20

Source = str | None


def order_of(source: Source) -> tuple[bool, str]:
    return source is not None, source or ""


def windows(weights: dict[Source, float]) -> dict[Source, tuple[int, int]]:
    """1 / w of each source with a weight above 0 as a fraction of whole numbers, w being its exact part of all weights."""
    if any(w < 0 or not math.isfinite(w) for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite and not negative, and not all 0")
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    total = int(sum(exact.values()) * scale)
    return {s: (total, int(x * scale)) for s, x in exact.items()}


def plan(weights: dict[Source, float], blocks: dict[Source, int]) -> Iterator[tuple[Source, int, int]]:
    """(source, block, slot) by rising slot; earliest deadline first among the blocks released."""
    of = windows(weights)
    release = lambda s, j: j * of[s][0] // of[s][1]
    due = lambda s, j: -(-(j + 1) * of[s][0] // of[s][1])
    waiting = [(0, order_of(s), 0, s) for s in of if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, name, j, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), name, j, s))
        end, name, j, s = heapq.heappop(ready)
        assert slot < end, "a deadline is missed"
        yield s, j, slot
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, j + 1), name, j + 1, s))
    for s in sorted(blocks.keys() - of.keys(), key=order_of):
        for j in range(blocks[s]):
            yield s, j, slot
            slot += 1


def size_weights(counts: dict[Source, int], alpha: float) -> dict[Source, float]:
    """Weights by a power of the sources' sizes: 1 is their own proportion, 0 equal weights."""
    return {s: n**alpha for s, n in counts.items()}


def _planned(spark: SparkSession, docs: DataFrame, weights: dict[Source, float] | None, alpha: float, block_rows: int | None, source_col: str, id_col: str) -> tuple[DataFrame, int] | None:
    """_row (all columns), _source, _id, _block, _slot, _at (place in the block), _first (rows before the block); and the number of rows."""
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: name them by something coarser")
    if not counts:
        return None
    total = sum(counts.values())
    block_rows = block_rows or max(LEAST_ROWS, -(-total // MOST_BLOCKS))
    weights = size_weights(counts, alpha) if weights is None else {s: weights.get(s, 0.0) for s in counts}
    names = sorted(counts, key=order_of)
    number = {s: i for i, s in enumerate(names)}
    planned = list(plan(weights, {s: -(-n // block_rows) for s, n in counts.items()}))
    source, block, slot = (np.fromiter(x, np.int64, len(planned)) for x in ((number[s] for s, _, _ in planned), (j for _, j, _ in planned), (t for _, _, t in planned)))
    rows = np.minimum(block_rows, np.array([counts[s] for s in names])[source] - block * block_rows)
    slots = spark.createDataFrame(pa.table({"_k": source.astype(np.int32), "_j": block, "_slot": slot, "_first": np.cumsum(rows) - rows}))
    numbers = spark.createDataFrame([(s, i) for s, i in number.items()], "_name string, _number int")
    keyed = docs.select(F.struct("*").alias("_row"), F.col(source_col).cast("string").alias("_source"), F.col(id_col).alias("_id")).withColumn("_order", F.xxhash64("_id", F.lit("mix")))
    keyed = ranked(keyed, ["_source"], ["_order", "_id"], ["_id"], max(64, total // 20_000), "_rank")
    keyed = keyed.withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("long")).withColumn("_at", F.col("_rank") % block_rows)
    # Both sides are bounded: a row for each source, and for each block of the plan.
    keyed = keyed.join(F.broadcast(numbers), F.col("_source").eqNullSafe(F.col("_name")))
    keyed = keyed.join(F.broadcast(slots), (F.col("_number") == F.col("_k")) & (F.col("_block") == F.col("_j")))
    return keyed.select("_row", "_source", "_id", "_block", "_slot", "_at", "_first"), total


def schedule(spark: SparkSession, docs: DataFrame, weights: dict[Source, float] | None = None, alpha: float = 0.5, block_rows: int | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, block, slot, position (gapless from 0, by slot) of every document."""
    found = _planned(spark, docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")), weights, alpha, block_rows, "source", "doc_id")
    if found is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), *[F.lit(0).cast("long").alias(c) for c in ("block", "slot", "position")]).limit(0)
    return found[0].select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), (F.col("_first") + F.col("_at")).alias("position"))


def positions(spark: SparkSession, docs: DataFrame, alpha: float = 0.5, block_rows: int | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The same rows and columns and `position`, by the schedule that `mix` follows."""
    found = _planned(spark, docs, None, alpha, block_rows, source_col, id_col)
    if found is None:
        return docs.withColumn("position", F.lit(0).cast("long"))
    return found[0].select("_row.*", (F.col("_first") + F.col("_at")).alias("position"))


def mix(spark: SparkSession, docs: DataFrame, weights: dict[Source, float] | None = None, alpha: float = 0.5, block_rows: int | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The same rows and columns, in the order of the schedule: partitions of successive positions, sorted, so that files written from it follow the mixture."""
    found = _planned(spark, docs, weights, alpha, block_rows, source_col, id_col)
    if found is None:
        return docs
    rows, total = found
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_position", F.col("_first") + F.col("_at"))
    # Positions are gapless, so a row's partition follows from its own and nothing is sampled.
    rows = rows.repartitionById(parts, F.floor(F.col("_position") * parts / total).cast("int"))
    return rows.sortWithinPartitions("_position").select("_row.*")
