"""Best-fit packing of token sequences, planned on the histogram of their lengths.

Documents are encoded whole, an end id is added, and only longer ones are cut, into pieces of `capacity` ids. The
driver sees one count for each length (at most `capacity` of them) and packs counts: lengths in falling order, each
into the open sequences with the least room that still holds it, all alike sequences in one step. The plan is a list
of runs (length, ranks, sequences, offset); its size depends on the number of lengths, not of documents. Each piece
then takes the slot planned for its rank among the pieces of its length.

`pack_mixed` keeps the order of a mixture: the documents at WINDOW successive positions of the schedule are packed by
themselves, in one task, and sequences are numbered window by window, so that any prefix of the sequences has the
mixture to within the documents of a window. Each window may leave its last sequence part full.

Null or empty texts are the end id alone. Very long texts are encoded whole and cut into pieces. Repeated rows are packed
each for itself; a null id is kept. Pieces of one length are alike for the plan: which of them takes which slot follows
from the ranks alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mixing
from .common import Scratch
from .tokens import encoder

Run = tuple[int, int, int, int, int]
#: Documents of the schedule that are packed together.
WINDOW = 4096


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs (length, first rank, number, first sequence, offset) and the number of sequences.

    A run places pieces of ranks first.. of a length at one offset of as many successive sequences.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, number)]
    rooms: list[int] = []  # its keys in order
    runs: list[Run] = []
    used = 0

    def put(left: int, first: int, n: int) -> None:
        if left:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                n = max(1, todo // (capacity // length))  # sequences that this length fills alone
                put(capacity, used, n)
                used += n
                continue
            left = rooms[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            # Once begun, a sequence has less room than those like it, so it takes pieces until none fits.
            fit = min(left // length, todo)
            take = min(n, todo // fit)
            runs += [(length, rank + i * take, take, first, capacity - left + i * length) for i in range(fit)]
            put(left - fit * length, first, take)
            if take < n:
                put(left, first + take, n - take)
            rank, todo = rank + fit * take, todo - fit * take
    return runs, used


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(path).encode, np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part_ids = ids[at : at + 4 * capacity]
                    n = len(part_ids) // 4
                    k = seen.get(n, 0)
                    seen[n] = k + 1
                    out.append((doc, piece, at // 4, n, zlib.crc32(part_ids), part, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return run


def _slots(runs: list[Run]):
    """Of (length, rank): sequence and offset, by a search in the runs of the length."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    high = int(table[:, 0].max()) + 1 if len(table) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(1) << 40
        starts = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            assert not len(length) or (length.max() < high and rank.max() < width)
            at = np.searchsorted(starts, length * width + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], [*names, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "pack")
    kind = dict(docs.dtypes)[id_col]
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(tokenizer, end_id, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, k long"
    )
    pieces = scratch.store(pieces, "pieces")
    tally = scratch.store(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = tally.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # The tally grows with the input, so it isn't broadcast.
    placed = pieces.join(first.hint("merge"), ["length", "part"]).withColumn("rank", F.col("first") + F.col("k"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _slots(runs), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def _pack_windows(capacity: int):
    """Sequences of each window, numbered from 0 by the earliest position in them; rows come sorted by window."""

    def place(t: pa.Table) -> pa.RecordBatch:
        length, position = t.column("length").to_numpy(), t.column("position").to_numpy()
        kinds, code, n = np.unique(length, return_inverse=True, return_counts=True)
        runs, used = plan(dict(zip(kinds.tolist(), n.tolist(), strict=True)), capacity)
        order = np.lexsort((t.column("piece").to_numpy(), position, code))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        table, width = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), np.int64(1) << 40
        at = np.searchsorted(table[:, 0] * width + table[:, 1], length * width + rank, side="right") - 1
        sequence = table[at, 3] + rank - table[at, 1]
        first = np.full(used, np.iinfo(np.int64).max)
        np.minimum.at(first, sequence, position)
        number = np.empty(used, np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(used)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "window"]
        t = t.combine_chunks()
        return pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in names], pa.array(number[sequence]), pa.array(table[at, 4])], [*names, "number", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            window = held.column("window").to_numpy()
            cuts = np.flatnonzero(window[1:] != window[:-1]) + 1
            for a, z in zip([0, *cuts[:-1]], cuts, strict=False):
                yield place(held.slice(a, z - a))
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and len(held):
            yield place(held)

    return run


def _keyed_pieces(path: str, end_id: int, capacity: int):
    """Pieces with the partition and the place of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part, row = encoder(path).encode, np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part_ids = ids[at : at + 4 * capacity]
                    out.append((doc, source, (part << 40) + row, piece, at // 4, len(part_ids) // 4, zlib.crc32(part_ids)))
                row += 1
            if out:
                kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "source", "key", "piece", "start", "length", "ids_crc32"])

    return run


def pack_mixed(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, alpha: float = 0.5, block_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """As `pack`, with sequences in the order of the schedule of `mixing.mix`."""
    scratch = Scratch(spark, "pack")
    kind = dict(docs.dtypes)[id_col]
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).mapInArrow(
        _keyed_pieces(tokenizer, end_id, capacity), f"doc_id {kind}, source string, key long, piece int, start long, length long, ids_crc32 long"
    )
    pieces = scratch.store(pieces, "pieces")
    at = mixing.positions(spark, pieces.where("piece = 0").select("doc_id", "source", "key"), alpha, block_rows).select("key", "position")
    windowed = pieces.drop("source").join(at, "key").drop("key").withColumn("window", F.floor(F.col("position") / WINDOW).cast("long"))
    windowed = windowed.repartition("window").sortWithinPartitions("window")
    names = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    placed = scratch.store(windowed.mapInArrow(_pack_windows(capacity), f"{names}, window long, number long, offset long"), "placed")
    scratch.keep("placed")
    sizes = placed.groupBy("window").agg((F.max("number") + 1).alias("n"))  # a row for each window
    before = F.sum("n").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("window", F.coalesce(before, F.lit(0)).alias("first"))
    return placed.join(F.broadcast(first), "window").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number")).alias("sequence_id"), "offset")
