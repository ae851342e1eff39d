"""Readers of the project's Parquet tables, and the rule that one valid row holds per (symbol, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def is_number(column: Column | str) -> Column:
    """True where a double is neither null nor NaN (infinities count as numbers)."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c)


def latest_rows(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per ``keys``: the values of the row with the largest ``order``.

    ``max_by`` over primitive columns keeps this a hash aggregation with map-side combining; rows sent again are
    superseded, also by a row whose value is null. Rows with equal ``order`` are taken as equal.
    """
    return df.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))
