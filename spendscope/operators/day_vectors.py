"""Sparse day vectors: the values of a key's days in one map.

A vector holds only the days that have rows, so a range of any length costs what
its rows cost, and neither the plan nor a job beforehand needs to know the days.
Matrices with one column per day, or one list per row, are views over vectors.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from spendscope.functions.bands import cost_band
from spendscope.functions.dates import as_date, iso

Day = date | str


def days_between(first: Day, last: Day) -> list[str]:
    first, last = as_date(first), as_date(last)
    return [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


def day_vectors(df: DataFrame, rows: Sequence[str], value: str = "cost", name: str = "days") -> DataFrame:
    """One row per row key with a map from day to the day's sum.

    Values of a day are added up where they are before anything meets, so a key
    with many rows is a few days by then. A day whose values are all missing stays
    in the map without a value; rows without a day are left out.
    """
    per_day = df.where(F.col("Date").isNotNull()).groupBy(*rows, "Date").agg(F.sum(f"`{value}`").alias(value))
    entries = F.sort_array(F.collect_list(F.struct("Date", value)))
    return per_day.groupBy(*rows).agg(F.map_from_entries(entries).alias(name))


def bands_of(vector: Column) -> Column:
    """Cost band of every day of a vector."""
    return F.transform_values(vector, lambda _, cost: cost_band(cost))


def cells(vector: Column, first: Day, last: Day) -> Column:
    """A vector as a list with one place per day of the range; a day without rows is missing.

    The vector's entries are dealt to their places by one pass over them, not
    by looking every day up in the map.
    """
    begin, n = F.lit(as_date(first)), (as_date(last) - as_date(first)).days + 1
    entries = F.filter(F.map_entries(vector), lambda e: e["key"].between(begin, F.lit(as_date(last))))
    places = F.transform(entries, lambda e: F.datediff(e["key"], begin))
    values = F.transform(entries, lambda e: e["value"])
    # each entry fills the days since the one before with missing values, then its own
    before = F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))))
    pieces = F.zip_with(F.zip_with(before, places, lambda a, b: b - a - 1), values, lambda gap, v: F.concat(F.array_repeat(F.lit(None).cast("double"), gap), F.array(v)))
    told = F.flatten(pieces)
    none = F.array_repeat(F.lit(None).cast("double"), n)
    return F.when(F.size(entries) == 0, none).otherwise(F.slice(F.concat(told, none), 1, n))


def day_columns(vectors: DataFrame, rows: Sequence[str], first: Day, last: Day, name: str = "days") -> DataFrame:
    """A column per day, named by its ISO date."""
    listed = vectors.select(*[f"`{r}`" for r in rows], cells(F.col(name), first, last).alias(name))
    return listed.select(*[f"`{r}`" for r in rows], *[F.col(name)[i].alias(d) for i, d in enumerate(days_between(first, last))])


def long_form(vectors: DataFrame, rows: Sequence[str], value: str = "cost", name: str = "days") -> DataFrame:
    """One row per key and day again."""
    return vectors.select(*[f"`{r}`" for r in rows], F.explode(name).alias("Date", value))


def listed(vectors: DataFrame, rows: Sequence[str], value: str = "cost", name: str = "days", bands: bool = False) -> DataFrame:
    """Aligned lists of days (ISO text), values and, if asked for, cost bands."""
    days = F.transform(F.map_keys(name), iso).alias("Date")
    more = [F.map_values(bands_of(F.col(name))).alias("band")] if bands else []
    return vectors.select(*[f"`{r}`" for r in rows], days, F.map_values(name).alias(value), *more)
