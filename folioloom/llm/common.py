"""What the training-data operators share: tables, shared scratch space, two-level ranks."""

from __future__ import annotations

import ctypes
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master (tests) may do without the setting; a cluster may not."""
    if told := spark.conf.get("spark.checkpoint.dir", ""):
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


class Scratch:
    """Tables and files of one operator run, in the shared folder. Written tables cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(self.sub(name))
        return self.spark.read.schema(df.schema).parquet(self.sub(name))

    def _delete(self, path) -> None:
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self._delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.sub(name)))

    def keep(self, *names: str) -> None:
        """Deletes all tables but those that the result still reads."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in where.listStatus(folder) if where.exists(folder) else ():
            if found.getPath().getName() not in names:
                self._delete(found.getPath())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(*cols: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def ranked(df: DataFrame, groups: list[str], order: list[Column | str], spread: list[Column | str], buckets: int, name: str) -> DataFrame:
    """Adds `name`: the row's gapless rank from 0 within `groups`, without ever gathering a group in one task.

    Rows go to `buckets` hash buckets of `spread` within each group; the bucket counts give each bucket's
    first rank, and rows are numbered inside their own bucket. The order is by bucket, then by `order`.
    """
    df = df.withColumn("_bucket", bucket_of(*[F.col(c) if isinstance(c, str) else c for c in spread], buckets=buckets))
    keys = [*groups, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    inner = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_in", F.row_number().over(inner) - 1).join(first, same).withColumn(name, (F.col("_first") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_first", *[f"_k{i}" for i in range(len(keys))])


def release_memory() -> None:
    """Gives a worker's freed memory back to the system; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
