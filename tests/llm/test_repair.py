"""Conversation repair against plain SQL and against all audits of short conversations."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import registry, repair

SCHEMA = "conv_id long, turn long, role string, text string, _part string, copies int, audit string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _conversations():
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(0, 9))):
            rows.append((conv, turn * (1 + conv % 3), str(rng.choice(["system", "user", "assistant", "tool", ""])) or None, str(rng.choice(["Yes.", "No", "Why? ", " \t", "", "Ends…", "a.b"]))))
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (61, None, "user", "x."), (61, None, "user", "x."), (61, 2**63 - 1, "assistant", None), (62, 1, "", "no role.")]
    rows += [(63, i, ("user", "assistant", "assistant", "user", "system")[i % 5 if i % 97 else 4], f"turn {i // 3}" + "." * (i % 4 > 0)) for i in range(4000)]
    rows += [(64, i // 50, "user", "again") for i in range(3000)]
    return [(*r, "x", 7, "y") for r in rows]


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return sorted(con.sql(registry.CONVERSATION_REPAIR_SQL).select(", ".join(COLUMNS)).fetchall(), key=str)


@pytest.fixture(scope="module")
def rows():
    return _conversations()


def test_equals_sql_with_conversations_cut_over_tasks(spark, rows):
    """Nulls, ties, equal rows, clashing names, a conversation over every task, one of equal rows."""
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    short = [r for r in rows if r[0] not in (63, 64)]
    assert sorted(map(tuple, repair.repair(spark, spark.createDataFrame(short, SCHEMA)).select(COLUMNS).collect()), key=str) == _sql(short)
    long = [r for r in rows if r[0] in (63, 64)]
    few = [r for r in long if r[1] is not None and r[1] < 400 or r[0] == 64]
    assert sorted(map(tuple, repair.repair(spark, spark.createDataFrame(few, SCHEMA)).select(COLUMNS).collect()), key=str) == _sql(few)
    assert repair.repair(spark, turns).count() == len({r[0] for r in rows})


def test_result_does_not_depend_on_partitions(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    found = []
    for n in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        done = repair.Repair(spark, repair.damage(turns))
        found.append((sorted(map(tuple, done.summary().select("_ck", *COLUMNS[1:-1]).collect()), key=str), done.pieces.groupBy("_cn", "_ck").count().agg(F.max("count")).first()[0]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0][0] == found[1][0] and found[1][1] > 3


def test_repaired_rows_are_legal_and_in_order(spark, rows):
    done = repair.Repair(spark, repair.damage(spark.createDataFrame(rows, SCHEMA)))
    told = {}
    for r in sorted(done.repaired().collect(), key=lambda r: (str(r["conv_id"]), r["part"], r["place"])):
        told[r["conv_id"]] = told.get(r["conv_id"], "") + r["role"][0]
    for roles in told.values():
        body = roles.removeprefix("s")
        assert body and body == "ua" * (len(body) // 2)


def _cost(audit, symbols):
    """Cost of an audit over symbols, or None where it leads to an illegal ending."""
    state, cost, at = 0, 0, 0
    for letter in audit:
        if letter == "I":
            state, cost = repair.follows(state), cost + 2
            continue
        if at == len(symbols):
            return None
        symbol, at = symbols[at], at + 1
        if letter == "D":
            cost += 3
            continue
        if symbol == repair.GONE:
            return None
        cost += symbol >= 4
        if letter == "R":
            state, cost = repair.follows(state), cost + 2
        elif (state := repair.kept(state, symbol % 4)) is None:
            return None
    return cost if at == len(symbols) and state in (0, 3) else None


@pytest.mark.parametrize("seed", range(12))
def test_audit_is_the_least_of_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(0, 9, int(rng.integers(1, 5))).tolist()
    ways = ((c, a) for n in range(len(symbols), len(symbols) + 4) for a in map("".join, itertools.product("DIKR", repeat=n)) if (c := _cost(a, symbols)) is not None)
    runs = [(k, len(list(g))) for k, g in itertools.groupby(symbols)]
    audit, _, cost = repair.unroll([k for k, _ in runs], [n for _, n in runs], repair.ending(), 0, True)
    assert (cost, audit) == min(ways)


def test_powers_equal_single_steps():
    for symbol in range(9):
        costs = repair.ending()
        for n in range(1, 40):
            costs = repair.ahead(symbol, 1, costs)
            assert repair.ahead(symbol, n, repair.ending()) == costs
    audit, state, cost = repair.unroll([1, 2], [5000, 3], repair.ending(), 0, True)
    assert len(audit) >= 5003 and state == 3 and cost == sum({"D": 3, "I": 2, "K": 0, "R": 2}[x] for x in audit)


def test_empty_table(spark):
    assert repair.repair(spark, spark.createDataFrame([], SCHEMA)).count() == 0
