"""Queries of the engine's operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, books, pixels, planes, planning, rasters, relations, texts  # noqa: F401  (they register their queries)
from .base import FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
