"""Conversation structure repair: run-length dynamic programming over min-plus transitions.

The rows of a conversation become symbols: the role's initial (s, u, a or another) and the row's fault. Equal consecutive
symbols are a run. What a run does to the four states of the grammar `(s?(ua)+)?` is the power of one 4 x 4 min-plus
matrix, built from cached binary powers; from the powers follow the least costs still ahead, and from these the choices.

Rows are dealt in ranges of (conversation, turn), so that a conversation of any size is cut over many tasks. A range cuts
one conversation at its start and one at its end at most: only these cut pieces, two for each task, are put together by the driver.

Nulls in role and text count as one space; a null turn comes first; a null identifier is a conversation. Equal rows of one
conversation are one row with a number of copies. Rows of equal turn are in the order of role and text. Empty tables give empty results,
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: States: nothing yet, after s, after u, after a. An ending is legal in the first and the last.
STATES, LEGAL, FAR = 4, (0, 3), 1 << 60
#: Symbols 0 to 3: s, u, a, other. 4 to 7: the same, truncated. 8: must be deleted.
GONE = 8
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a run whose costs ahead are held at once while choices are unrolled.
UNROLL = 1024

Matrix = tuple[tuple[int, ...], ...]


def follows(state: int) -> int:
    """The state after the only role that may be inserted or given in a state: an answer after u, else u."""
    return 3 if state == 2 else 2


def kept(state: int, role: int) -> int | None:
    """The state after a row that keeps its role, or None where the grammar forbids it."""
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return 2 if state != 2 else None
    return 3 if role == 2 and state == 2 else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, min(a[i][k] + b[k][j] for k in range(STATES))) for j in range(STATES)) for i in range(STATES))


@lru_cache
def transition(symbol: int) -> Matrix:
    """Least cost from state to state over insertions and then one row of a symbol."""
    role, cut = symbol % 4, CUT if symbol >= 4 else 0
    step = [[FAR] * STATES for _ in range(STATES)]
    for first in range(STATES):
        state = first
        for inserted in range(STATES):  # further insertions only repeat a state
            spent, row = INSERT * inserted, step[first]
            row[state] = min(row[state], spent + DELETE)
            if symbol != GONE:
                row[follows(state)] = min(row[follows(state)], spent + REROLE + cut)
                if (to := kept(state, role)) is not None:
                    row[to] = min(row[to], spent + cut)
            state = follows(state)
    return tuple(map(tuple, step))


@lru_cache
def power(symbol: int, bit: int) -> Matrix:
    """The transition of 2 ** bit rows of a symbol."""
    return transition(symbol) if bit == 0 else times(power(symbol, bit - 1), power(symbol, bit - 1))


def ahead(symbol: int, n: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs ahead of n rows of a symbol, from the costs behind them."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            costs = tuple(min(FAR, min(a + b for a, b in zip(row, costs, strict=True))) for row in power(symbol, bit))
    return costs


def ending() -> tuple[int, ...]:
    """Costs at the end of a conversation: what must still be inserted."""
    costs = []
    for state in range(STATES):
        n = 0
        while state not in LEGAL:
            state, n = follows(state), n + 1
        costs.append(INSERT * n)
    return tuple(costs)


def product(symbols: list[int], lengths: list[int]) -> Matrix:
    """The transition of a list of runs."""
    whole: Matrix = tuple(tuple(0 if i == j else FAR for j in range(STATES)) for i in range(STATES))
    for symbol, n in zip(symbols, lengths, strict=True):
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                whole = times(whole, power(symbol, bit))
    return whole


def _letters(symbol: int, n: int, costs: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest choices over n rows of a symbol, and the state after them."""
    role, cut, letters = symbol % 4, CUT if symbol >= 4 else 0, []
    after = [costs]
    for _ in range(n):
        after.append(ahead(symbol, 1, after[-1]))
    for left in range(n, 0, -1):
        here, then = after[left], after[left - 1]
        while True:
            if DELETE + then[state] == here[state]:
                letters.append("D")
                break
            if INSERT + here[follows(state)] == here[state]:
                letters.append("I")
                state = follows(state)
                continue
            to = kept(state, role) if symbol != GONE else None
            if to is not None and cut + then[to] == here[state]:
                letters.append("K")
                state = to
                break
            letters.append("R")
            state = follows(state)
            break
    return "".join(letters), state


def unroll(symbols: list[int], lengths: list[int], costs: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """Choices for a list of runs with the costs behind them, from a state: letters, state after them and cost. `last` adds the insertions at the end."""
    pieces = []
    for symbol, n in zip(reversed(symbols), reversed(lengths), strict=True):
        behind = n
        while behind:  # the costs behind each piece of a run by powers, those inside when it is unrolled
            size = min(UNROLL, behind)
            pieces.append((symbol, size, costs))
            behind -= size
            costs = ahead(symbol, size, costs)
    cost, letters = costs[state], []
    for symbol, n, behind in reversed(pieces):
        told, state = _letters(symbol, n, behind, state)
        letters.append(told)
    if last:
        while state not in LEGAL:
            letters.append("I")
            state = follows(state)
    return "".join(letters), state, cost


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of rows after damage by crc32 of `conv_id:turn` modulo 20."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    spoilt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return df.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


#: Order of rows: conversations, then turns with nulls first.
ORDER = ["_cn", "_ck", "_tn", "_tk", "role", "text"]


def _rows(damaged: DataFrame) -> DataFrame:
    """Equal rows once with their number of copies, whether a row is the first of its role and text, and its symbol."""
    zero = {c: F.lit(None).cast(damaged.schema[c].dataType) for c in ("conv_id", "turn")}
    fill = {c: F.lit("" if isinstance(damaged.schema[c].dataType, T.StringType) else 0).cast(damaged.schema[c].dataType) for c in zero}
    keyed = damaged.select(
        F.col("conv_id").isNotNull().alias("_cn"),
        F.coalesce("conv_id", fill["conv_id"]).alias("_ck"),
        F.col("turn").isNotNull().alias("_tn"),
        F.coalesce("turn", fill["turn"]).alias("_tk"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_said"),
        "role",
        "text",
        "copies",
    )
    place = ["_cn", "_ck", "_tn", "_tk", "_said"]
    rows = keyed.groupBy(*place).agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    # one row for each saying: its first turn; joined by turn as well, a key stands once on either side
    said = keyed.groupBy("_cn", "_ck", "_said").agg(F.min("_tn").alias("_tn"), F.min(F.when(F.col("_tn"), F.col("_tk"))).alias("_tk"))
    said = said.select("_cn", "_ck", "_tn", F.when(F.col("_tn"), F.col("_tk")).otherwise(fill["turn"]).alias("_tk"), "_said", F.lit(True).alias("_new"))
    rows = rows.join(said, place, "left")
    bare = F.btrim("text", F.lit(WHITE))
    blank, ends = bare == "", F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(blank | F.col("_new").isNull(), GONE).when(ends, role).otherwise(role + 4)
    return rows.select(*ORDER, "copies", role.cast("byte").alias("_role"), blank.alias("_blank"), symbol.cast("byte").alias("_symbol"))


PIECE = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("blank", "duplicate", "truncated", "illegal", "turns")]
    + [T.StructField(n, T.LongType()) for n in ("least", "most")]
    + [T.StructField(n, T.IntegerType(), False) for n in ("first_role", "last_role")]
    + [T.StructField("symbols", T.ArrayType(T.ByteType(), False), False), T.StructField("lengths", T.ArrayType(T.LongType(), False), False), T.StructField("edge", T.BooleanType(), False)]
)
_LEGAL_PAIRS = np.array([[b == 1 and a in (0, 2) or (a, b) == (1, 2) for b in range(4)] for a in range(4)])


class _Piece:
    """What a task has seen of one conversation."""

    def __init__(self, edge: bool):
        self.edge, self.symbols, self.lengths, self.last_role, self.last_turn, self.first_role = edge, [], [], None, None, None
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = None

    def add(self, turn: np.ndarray, told: np.ndarray, role: np.ndarray, blank: np.ndarray, symbol: np.ndarray, copies: np.ndarray) -> None:
        more = int((copies - 1).sum())
        blanks = int(copies[blank].sum())
        single = int(((symbol == GONE) & ~blank).sum())
        self.n["blank"] += blanks
        self.n["duplicate"] += single + int((copies - 1)[~blank].sum())
        self.n["truncated"] += int(((symbol >= 4) & (symbol != GONE)).sum())
        pairs = int((~_LEGAL_PAIRS[role[:-1], role[1:]]).sum()) + more
        if self.last_role is None:
            self.first_role = int(role[0])
        else:
            pairs += not _LEGAL_PAIRS[self.last_role, role[0]]
        self.n["illegal"] += int(pairs)
        self.last_role = int(role[-1])
        known = turn[told]
        if len(known):
            self.n["turns"] += 1 + int((known[1:] != known[:-1]).sum()) - int(self.last_turn == known[0])
            self.least = int(known[0]) if self.least is None else self.least
            self.most = self.last_turn = int(known[-1])
        # a row, then its further copies, which must go
        runs = np.empty(2 * len(symbol), np.int64)
        sizes = np.empty(2 * len(symbol), np.int64)
        runs[::2], runs[1::2], sizes[::2], sizes[1::2] = symbol, GONE, 1, copies - 1
        runs, sizes = runs[sizes > 0], sizes[sizes > 0]
        at = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        heads, sums = runs[at].tolist(), np.add.reduceat(sizes, at).tolist()
        if self.symbols and self.symbols[-1] == heads[0]:
            self.lengths[-1] += sums[0]
            heads, sums = heads[1:], sums[1:]
        self.symbols += heads
        self.lengths += sums

    def row(self) -> dict:
        return self.n | {"least": self.least, "most": self.most, "first_role": self.first_role, "last_role": self.last_role, "symbols": self.symbols, "lengths": self.lengths, "edge": self.edge}


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their place in the task; the last row of each conversation carries its piece."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    kind, part = to_arrow_type(PIECE), TaskContext.get().partitionId()
    held: pa.Table | None = None
    piece, owner, place, own = None, None, 0, 0

    def out(rows: pa.Table, pieces: list) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        whole = rows.select([*ORDER, "copies"]).append_column("_part", pa.array([part] * n, pa.int32())).append_column("_place", pa.array(range(place, place + n), pa.int64()))
        yield from whole.append_column("_piece", pa.array(pieces, kind)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        cn, ck = rows["_cn"].to_numpy(zero_copy_only=False), rows["_ck"].to_pandas().to_numpy()
        told, turn = rows["_tn"].to_numpy(zero_copy_only=False).astype(bool), rows["_tk"].to_numpy(zero_copy_only=False)
        role, blank, symbol, copies = (rows[c].to_numpy(zero_copy_only=False) for c in ("_role", "_blank", "_symbol", "copies"))
        blank = blank.astype(bool)
        cuts = np.flatnonzero(np.concatenate(([True], (cn[1:] != cn[:-1]) | (ck[1:] != ck[:-1])))).tolist()
        pieces: list = [None] * len(cn)
        for a, b in zip(cuts, [*cuts[1:], len(cn)], strict=True):
            if owner != (cn[a], ck[a]):
                if piece is not None:
                    done, piece = piece.row(), None
                    if a:
                        pieces[a - 1] = done
                    else:
                        yield from out(held, [done])
                        place, held = place + 1, None
                owner, piece, own = (cn[a], ck[a]), _Piece(own == 0), own + 1
            piece.add(turn[a:b], told[a:b], role[a:b], blank[a:b], symbol[a:b], copies[a:b])
        if held is not None:
            yield from out(held, [None])
            place += 1
        yield from out(rows.slice(0, len(cn) - 1), pieces[:-1])
        place += len(cn) - 1
        held = rows.slice(len(cn) - 1)
    if piece is not None:
        piece.edge = True
        yield from out(held, [piece.row()])


def _choices(pieces: DataFrame, costs: dict) -> DataFrame:
    """audit, cost and state behind each piece for each state before it (just the first state, where a conversation is one piece). `costs` has the cut pieces: the costs behind them."""
    known = pieces.sparkSession.sparkContext.broadcast(costs)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, first, piece in zip(*(batch[c].to_pylist() for c in ("_part", "_first", "_piece")), strict=True):
                behind = known.value.get((part, first))
                for state in range(STATES) if behind else (0,):
                    audit, after, cost = unroll(piece["symbols"], piece["lengths"], behind[0] if behind else ending(), state, behind is None or behind[1])
                    out.append((part, first, state, audit, after, cost))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["_part", "_first", "_state", "audit", "_after", "cost"])

    kinds = [pa.int32(), pa.int64(), pa.int8(), pa.string(), pa.int8(), pa.int64()]
    return pieces.mapInArrow(told, "_part int, _first long, _state byte, audit string, _after byte, cost long")


def _scan(cut: list) -> tuple[dict, list[list[tuple]]]:
    """Of the pieces of cut conversations: the costs behind each, and the pieces of each conversation in order."""
    costs, whole = {}, []
    cut = sorted(cut, key=lambda r: (r["_cn"], r["_ck"], r["_part"]))
    for _, rows in groupby(cut, key=itemgetter("_cn", "_ck")):
        rows, behind = list(rows), ending()
        for i, row in enumerate(reversed(rows)):
            costs[row["_part"], row["_first"]] = (behind, i == 0)
            matrix = row["matrix"]
            behind = tuple(min(FAR, min(matrix[STATES * a + b] + behind[b] for b in range(STATES))) for a in range(STATES))
        whole.append([(r["_part"], r["_first"]) for r in rows])
    return costs, whole


@F.udf(T.ArrayType(T.LongType()))
def _matrix(symbols, lengths):
    return [x for row in product(symbols, lengths) for x in row]


class Repair:
    """The repair of damaged conversations: `pieces` with each piece's audit and cost, `rows` in order."""

    def __init__(self, spark: SparkSession, damaged: DataFrame):
        self.scratch = Scratch(spark, "repair")
        # ranges by the start of a text, so that bounds stay short; rows of one range key share a task and are sorted by the whole
        rows = _rows(damaged).repartitionByRange(*ORDER[:-1], F.substring("text", 1, 256)).sortWithinPartitions(*ORDER)
        kinds = {f.name: f.dataType for f in rows.schema}
        schema = T.StructType([*[T.StructField(c, kinds[c]) for c in (*ORDER, "copies")], T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType()), T.StructField("_piece", PIECE)])
        self.rows = self.scratch.store(rows.mapInArrow(_pieces, schema), "rows")
        # a piece is named by its task and its last row's place
        pieces = self.rows.where("_piece IS NOT NULL").select("_cn", "_ck", "_part", F.col("_place").alias("_first"), "_piece")
        owner = ["_cn", "_ck"]
        edges = pieces.where("_piece.edge")
        # two pieces for each task at most: one conversation goes on from the task before, one into the task behind
        shared = edges.groupBy(*owner).count().where("count > 1").select(*owner)
        cut = edges.join(shared, owner).select(*owner, "_part", "_first", _matrix("_piece.symbols", "_piece.lengths").alias("matrix")).collect()
        costs, whole = _scan(cut)
        told = self.scratch.store(_choices(pieces.select("_part", "_first", "_piece"), costs), "choices")
        taken = []
        if costs:
            ways = {(r["_part"], r["_first"], r["_state"]): r["_after"] for r in told.join(edges.join(shared, owner).select("_part", "_first"), ["_part", "_first"]).select("_part", "_first", "_state", "_after").collect()}
            for parts in whole:
                state = 0
                for i, (part, first) in enumerate(parts):
                    taken.append((part, first, state, i > 0))
                    state = ways[part, first, state]
        right = spark.createDataFrame(taken, "_part int, _first long, _state byte, _later boolean")
        # a piece of an uncut conversation has the first state only
        chosen = told.join(right, ["_part", "_first", "_state"], "left").join(right.select("_part", "_first", F.lit(True).alias("_is_cut")).distinct(), ["_part", "_first"], "left")
        chosen = chosen.where("_is_cut IS NULL OR _later IS NOT NULL").select("_part", "_first", "_state", "audit", F.when(F.coalesce("_later", F.lit(False)), None).otherwise(F.col("cost")).alias("cost"))
        self.pieces = pieces.join(chosen, ["_part", "_first"])

    def summary(self) -> DataFrame:
        """A row for each conversation with rows: faults, gaps, illegal neighbours, cost and audit."""
        before = Window.partitionBy("_cn", "_ck").orderBy("_part")
        p = self.pieces.select("_cn", "_ck", "_part", "audit", "cost", "_piece.*")
        wrong = ~((F.col("first_role") == 1) & F.col("_role").isin(0, 2) | (F.col("first_role") == 2) & (F.col("_role") == 1))
        p = p.withColumn("_role", F.lag("last_role").over(before)).withColumn("_most", F.lag("most").over(before))
        p = p.withColumn("illegal", F.col("illegal") + F.when(F.col("_role").isNotNull() & wrong, 1).otherwise(0)).withColumn("turns", F.col("turns") - F.when(F.col("_most") == F.col("least"), 1).otherwise(0))
        wide = {c: F.col(c).cast("decimal(38,0)") for c in ("_least", "_most", "_turns")}
        df = p.groupBy("_cn", "_ck").agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
            F.min("least").alias("_least"),
            F.max("most").alias("_most"),
            F.sum("turns").alias("_turns"),
            # a piece for each task at most
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        )
        gaps = (wide["_most"] - wide["_least"] + 1 - wide["_turns"]).cast("long")
        return df.withColumn("gaps", F.coalesce(gaps, F.lit(0).cast("long"))).drop("_least", "_most", "_turns")

    def _told(self, keys: list[str]) -> DataFrame:
        """Rows behind the audit of their piece (with the state before it as copies), each piece in order, dealt by `keys`."""
        own = [F.col(c) for c in ("_cn", "_ck", "_part")]
        heads = self.pieces.select(*own, F.lit(-1).cast("long").alias("_place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.col("_state").cast("long").alias("copies"))
        rows = self.rows.select(*own, "_place", "role", "text", "copies")
        return heads.unionByName(rows).repartition(*[F.col(k) for k in keys]).sortWithinPartitions("_cn", "_ck", "_part", "_place")

    def repaired(self) -> DataFrame:
        """The turns of repaired conversations: conv_id, part and place (their order), edit (K, R or I), role and text. Pieces of one conversation are dealt apart."""

        def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, lines in _edited(batches):
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in lines], schema=schema)

        from pyspark.sql.pandas.types import to_arrow_type

        kind = self.rows.schema["_ck"].dataType
        names = ["_cn", "_ck", "part", "place", "edit", "role", "text"]
        schema = pa.schema(list(zip(names, [pa.bool_(), to_arrow_type(kind), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)))
        df = self._told(["_cn", "_ck", "_part"]).mapInArrow(edited, f"_cn boolean, _ck {kind.simpleString()}, part int, place long, edit string, role string, text string")
        return df.select(F.when(F.col("_cn"), F.col("_ck")).alias("conv_id"), "part", "place", "edit", "role", "text")

    def hashes(self) -> DataFrame:
        """SHA-256 of the `role:text` lines of each repaired conversation. The digest reads a conversation in order, so its rows stream through one task, a batch at a time."""

        def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owner, digest, lines = None, None, 0

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([{"_cn": owner[0], "_ck": owner[1], "repaired_sha256": digest.hexdigest()}], schema=schema)

            for owners, found in _edited(batches, heads=True):
                out = []
                for cn, ck, _, _, edit, role, text in found:
                    if owner != (cn, ck):
                        if owner is not None:
                            out.append(done())
                        owner, digest, lines = (cn, ck), hashlib.sha256(), 0
                    if edit is not None:
                        digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                        lines += 1
                if out:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            if owner is not None:
                yield done()

        from pyspark.sql.pandas.types import to_arrow_type

        kind = self.rows.schema["_ck"].dataType
        schema = pa.schema([("_cn", pa.bool_()), ("_ck", to_arrow_type(kind)), ("repaired_sha256", pa.string())])
        return self._told(["_cn", "_ck"]).mapInArrow(digests, f"_cn boolean, _ck {kind.simpleString()}, repaired_sha256 string")


def repair(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """A row for every conversation of `turns`: its faults after damage, the cheapest edits and the digest of what they leave."""
    done = Repair(spark, damage(turns))
    zero = F.lit("" if isinstance(turns.schema["conv_id"].dataType, T.StringType) else 0).cast(turns.schema["conv_id"].dataType)
    every = turns.select(F.col("conv_id").isNotNull().alias("_cn"), F.coalesce("conv_id", zero).alias("_ck")).distinct()
    df = every.join(done.summary(), ["_cn", "_ck"], "left").join(done.hashes(), ["_cn", "_ck"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return df.select(F.when(F.col("_cn"), F.col("_ck")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _edited(batches: Iterable[pa.RecordBatch], heads: bool = False) -> Iterator[tuple[int, Iterator[tuple]]]:
    """For each batch, its number of rows and the repaired turns that follow from them; `heads` adds a turn without edit where a piece starts."""
    audit, at, place, state, owner, trailing = "", 0, 0, 0, None, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            yield (*owner, place, "I", "assistant" if state == 2 else "user", "")
            state, at, place = follows(state), at + 1, place + 1

    def turns(batch: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal audit, at, place, state, owner
        columns = (batch[c].to_pylist() for c in ("_cn", "_ck", "_part", "_place", "role", "text", "copies"))
        for cn, ck, part, number, role, text, copies in zip(*columns, strict=True):
            if number < 0:
                if owner is not None:
                    yield from inserted()
                owner, audit, at, place, state = (cn, ck, part), text, 0, 0, copies
                if heads:
                    yield (cn, ck, part, 0, None, None, None)
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = "assistant" if state == 2 else "user", follows(state)
                else:
                    state = kept(state, "sua".find(role[:1]))
                yield (*owner, place, edit, role, text)
                place += 1

    for batch in batches:
        yield batch.num_rows, turns(batch)
    if owner is not None:
        yield 0, inserted()
