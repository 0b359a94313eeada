"""Matrices with one column per day: views over sparse day vectors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from spendscope.functions.bands import cost_band
from spendscope.functions.dates import within
from spendscope.operators.day_vectors import day_columns, day_vectors, days_between
from spendscope.operators.rollup import duplicate_keys

__all__ = ["day_matrix", "days_between", "with_bands"]


def day_matrix(
    df: DataFrame,
    rows: Sequence[str],
    first: date | str,
    last: date | str,
    value: str = "cost",
    strict: bool = False,
) -> DataFrame:
    """``value`` per row key and day; a day without rows stays missing.

    Several values of one cell are added up; ``strict`` refuses them instead.
    The columns come from the calendar, so no job is run to find them. Ranges
    of many months are better kept as vectors.
    """
    chosen = df.where(within(F.col("Date"), first, last))
    if strict and not duplicate_keys(chosen, [*rows, "Date"]).isEmpty():
        raise ValueError(f"several {value} values for one cell of {list(rows)} and Date")
    return day_columns(day_vectors(chosen, rows, value), rows, first, last)


def with_bands(matrix: DataFrame, rows: Sequence[str]) -> DataFrame:
    """Cost band next to every day column, as ``<day> band``."""
    days = [c for c in matrix.columns if c not in rows]
    return matrix.withColumns({f"{d} band": cost_band(F.col(f"`{d}`")) for d in days})
