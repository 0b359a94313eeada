"""Bounds of stored columns from Parquet statistics, without reading rows.

Spark answers min, max and count from file footers when aggregates are pushed into
its newer Parquet source. That needs two settings, which are made in a
session of their own, so no other query plans differently.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

_PUSHED = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_bounds(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row (min_<c>, max_<c> of each column) that the footers of the files at ``path`` answer.

    Dates and numbers can be answered so; columns that folders are partitioned by
    cannot be part of it. The plan's scan shows ``PushedAggregation``.
    """
    session = spark.newSession()
    for key, value in _PUSHED.items():
        session.conf.set(key, value)
    found = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return session.read.parquet(path).agg(*found)


def stored_range(spark: SparkSession, path: str, column: str = "Date") -> tuple[date, date] | None:
    """First and last value of a stored column; None where there is none."""
    low, high = footer_bounds(spark, path, column).first()
    return None if low is None else (low, high)


def stored_bounds(spark: SparkSession, path: str, columns: Sequence[str]) -> dict[str, tuple]:
    row = footer_bounds(spark, path, *columns).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in columns}
