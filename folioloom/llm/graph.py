"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and label, the smallest node of its component, for every node of edges (a, b) of longs.

    Rounds of minima over neighbours and a jump to the label's label, each written and read back, until none changes.
    """
    both = edges.select("a", "b").where("a <> b").distinct()
    both = scratch.store(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        lower = lower.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label"))
        lower = scratch.store(lower, f"{name}-{turn}")
        if lower.where("old <> label").isEmpty():
            scratch.drop(f"{name}-edges", f"{name}-{turn - 1}")
            return lower.select("node", "label")
        labels = lower.select("node", "label")
        scratch.drop(f"{name}-{turn - 1}")
