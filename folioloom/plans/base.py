"""How queries are registered, and the relations they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says the same."""

    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pages: parts stand for pages of a width and a height, brands for books.
PAGES_SQL = "SELECT p_partkey, p_brand, (300 + 40 * p_size)::BIGINT AS w, floor(p_retailprice)::BIGINT AS h FROM part"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "cast(300 + 40 * p_size AS int) AS w", "cast(floor(p_retailprice) AS int) AS h")
