"""Balanced label propagation: documents with equal texts move to one shard, under quotas, and counts stay even.

Only DataFrame operations. Documents are linked through their group (a text that occurs more than once). Each round,
a group counts its documents in each shard and moves to the shard that can hold most of it, at first to a random one
of equals. Larger gains go first, as far as the room goes; what fits whole is never split. Rounds end when no move is
granted: each move takes documents from those without a shard, or raises the sum of the squares of a group's counts.
Documents without links then fill the shards up, so that the law `rows` holds: counts differ by one at most. A group
larger than a shard fills shards one after another.

Rounds work on the counts, a row for each group with at most `shards` of them; ranks come from bucket counts, and
nothing is gathered by group, so one group may hold any part of the rows. Null texts have size 1 and form one group like any other text; null identifiers
and repeated rows are placed like other rows. Very long texts count by their bytes like others. Of equal gains, a hash of group and shard decides. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, ranked


#: The shard of documents that have none yet.
POOL = -1


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _sizes(df: DataFrame, shards: int, rows: Column | None = None) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.sum(F.lit(1) if rows is None else rows).alias("n")).collect()}  # a row for each shard
    return [found.get(s, 0) for s in range(shards)]


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, h: a + h["n"])


def _granted(held: DataFrame, room: Column, shards: int, parts: int) -> DataFrame:
    """group, to, fits, have, grant: what moves of each group to the shard that can hold most of it, by falling gain as far as the room goes."""
    room_of = lambda s: F.element_at(room, s + 1)
    have = lambda s: _total(F.filter("held", lambda h: h["shard"] == s))
    every = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: room_of(s) > 0)
    # Equal shards are told apart by a hash: the first labels are random.
    best = F.array_max(F.transform(every, lambda s: F.struct(F.least(F.col("members"), have(s) + room_of(s)).alias("gain"), have(s).alias("have"), F.xxhash64(F.col("group"), s).alias("by"), s.alias("to"))))
    votes = held.withColumn("members", _total(F.col("held"))).where(f"size(held) > 1 OR held[0].shard = {POOL}").withColumn("best", best).where("best IS NOT NULL")
    votes = votes.select("group", "held", "members", "best.gain", "best.have", "best.to").withColumn("fits", F.col("gain") == F.col("members"))
    votes = votes.select("group", "to", "gain", "fits", "have", _total(F.filter("held", _moves)).alias("n")).where("n > 0").withColumn("bucket", bucket_of(F.col("group"), buckets=parts))
    # Two levels: counts of (to, gain, bucket) first, then the groups of each.
    cells = votes.groupBy("to", "gain", "bucket").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("to").orderBy(F.col("gain").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("to", "gain", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first")).where(F.col("first") < room_of(F.col("to")))
    inner = Window.partitionBy("to", "gain", "bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    free = room_of(F.col("to")) - F.col("first") - F.coalesce(F.sum("n").over(inner), F.lit(0))
    out = votes.join(cells, ["to", "gain", "bucket"]).withColumn("free", free)
    return out.withColumn("grant", F.when(F.col("n") <= F.col("free"), F.col("n")).when(F.col("fits"), F.lit(0)).otherwise(F.col("free"))).where("`grant` > 0").select("group", "to", "fits", "have", "grant")


def _moves(h: Column) -> Column:
    """Whether documents of a shard would move: all if the group fits whole, else those of the pool and of smaller counts."""
    return (h["shard"] != F.col("to")) & (F.col("fits") | (h["shard"] == POOL) | (h["n"] < F.col("have")) | ((h["n"] == F.col("have")) & (h["shard"] > F.col("to"))))


def _moved(rows: DataFrame) -> DataFrame:
    """group, held after the grants; of a group the pool moves first, then the smallest counts."""
    movers = F.array_sort(F.transform(F.filter("held", _moves), lambda h: F.struct((h["shard"] != POOL).alias("late"), h["n"].alias("n"), h["shard"].alias("shard"))))
    rows = rows.withColumn("movers", movers)
    taken = lambda h, i: F.greatest(F.lit(0), F.least(h["n"], F.col("grant") - _total(F.slice("movers", F.lit(1), i))))
    left = F.transform("movers", lambda h, i: F.struct(h["shard"].alias("shard"), (h["n"] - taken(h, i)).alias("n")))
    stay = F.filter("held", lambda h: (h["shard"] != F.col("to")) & ~_moves(h))
    new = F.concat(stay, left, F.array(F.struct(F.col("to").alias("shard"), (F.col("have") + F.col("grant")).alias("n"))))
    return rows.select("group", F.when(F.col("to").isNull(), F.col("held")).otherwise(F.array_sort(F.filter(new, lambda h: h["n"] > 0))).alias("held"))


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    scratch = Scratch(spark, "shard")
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.sha2(F.coalesce(text, F.lit("\x00null")).cast("binary"), 256).alias("key"))
    base = scratch.store(base.withColumn("copy", F.monotonically_increasing_id()), "base")
    total = base.count()
    parts = max(64, total // 20_000)
    groups = base.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "members", F.xxhash64("key").alias("group"))
    # Keys with over a thousandth of the rows, a thousand of them at most, are joined by broadcast; no other key is hot.
    hot = groups.where(F.col("members") * 1000 > total)
    marked = base.join(F.broadcast(hot.select("key", F.col("group").alias("hot"))), "key", "left")
    members = marked.where("hot IS NOT NULL").select("copy", F.col("hot").alias("group"))
    members = members.unionByName(marked.where("hot IS NULL").join(groups.where(F.col("members") * 1000 <= total), "key").select("copy", "group"))
    members = scratch.store(members, "members")
    # Documents of a group are alike: counts move, and documents take their shards from the final counts.
    held = members.groupBy("group").agg(F.array(F.struct(F.lit(POOL).alias("shard"), F.count(F.lit(1)).alias("n"))).alias("held"))
    held = scratch.store(held, "held0")
    quota, turn = _quota(total, shards), 0
    while True:
        sizes = _sizes(held.select(F.explode("held").alias("h")).select("h.*"), shards, F.col("n"))
        room = _literal([max(0, q - n) for q, n in zip(quota, sizes, strict=True)])
        granted = scratch.store(_granted(held, room, shards, parts), f"granted{turn}")
        if granted.isEmpty():
            break
        held = scratch.store(_moved(held.join(granted, "group", "left")), f"held{turn + 1}")
        scratch.drop(f"held{turn}")
        scratch.drop(f"granted{turn}")
        turn += 1
    before = lambda i: _total(F.slice("held", F.lit(1), i + 1))
    ends = held.select("group", F.transform("held", lambda h, i: F.struct(before(i).alias("end"), h["shard"].alias("shard"))).alias("ends"))
    ends = ends.withColumn("often", F.element_at("ends", -1)["end"] * 1000 > total)
    places = ranked(members, ["group"], ["copy"], ["copy"], parts, "rank")
    ours = places.join(F.broadcast(ends.where("often").select("group", F.col("ends").alias("hot"))), "group", "left")
    own = lambda c: F.filter(c, lambda e: e["end"] > F.col("rank"))[0]["shard"].alias("shard")
    dealt = ours.where("hot IS NOT NULL").select("copy", "group", own("hot"))
    linked = scratch.store(dealt.unionByName(ours.where("hot IS NULL").join(ends.where("NOT often"), "group").select("copy", "group", own("ends"))), "linked")
    # Linked documents beyond a quota, and all others, fill the rest.
    keep = scratch.store(ranked(linked, ["shard"], ["group", "copy"], ["copy"], parts, "place").where(F.col("place") < F.element_at(_literal(quota), F.col("shard") + 1)).select("copy", "shard"), "keep")
    scratch.keep("base", "keep")
    sizes = _sizes(keep, shards)
    ends, at = [], 0
    for q, n in zip(quota, sizes, strict=True):
        at += q - n
        ends.append(at)
    rest = ranked(base.select("copy").join(keep, "copy", "left_anti"), [], ["copy"], ["copy"], parts, "place")
    filled = rest.select("copy", F.size(F.filter(_literal(ends), lambda end: end <= F.col("place"))).alias("shard"))
    out = base.drop("key").join(keep.select("copy", "shard").unionByName(filled), "copy")
    out = ranked(out, ["shard"], ["copy"], ["copy"], parts, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
