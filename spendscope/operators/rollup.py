"""Group sums and the small aggregates around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.ratios import protected_ratio, raw_ratio


def total(measure: str | Column) -> Column:
    """Sum that is 0, not missing, when nothing is there to add."""
    column = F.col(f"`{measure}`") if isinstance(measure, str) else measure
    return F.coalesce(F.sum(column), F.lit(0.0))


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with every key present. Plain null tests stay visible to the
    optimiser, which turns outer joins below into inner ones."""
    return df.where(reduce(and_, [F.col(f"`{k}`").isNotNull() for k in keys]))


def sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per key of rows whose keys are known to be present."""
    return df.groupBy(*keys).agg(*[total(m).alias(m) for m in measures])


def group_sum(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums per key; rows with a missing key take no part."""
    return sum_by(drop_null_keys(df, keys), keys, measures)


def grand_total(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row of sums, also for an empty input."""
    return df.agg(*[total(m).alias(m) for m in measures])


def first_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First present value of every other column per key."""
    rest = [c for c in df.columns if c not in keys]
    return (
        drop_null_keys(df, keys)
        .groupBy(*keys)
        .agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in rest])
    )


def extremes(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value of a column, as one row."""
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def column_maxima(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; joining on them multiplies rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def with_ratios(df: DataFrame, scale: float = 1.0, sensor_roi: str = n.SENSOR_ROI) -> DataFrame:
    """Protected ROI and CPC, raw rates times ``scale``, from summed measures."""
    c = F.col
    return df.withColumns({
        sensor_roi: protected_ratio(c("GMV"), c("cost")),
        n.ADS_ROI: protected_ratio(c("ads value"), c("cost")),
        n.CPC: protected_ratio(c("cost"), c("click")),
        n.CTR: raw_ratio(c("click"), c("impression"), scale),
        n.CONVERSION: raw_ratio(c("Sale"), c("UV"), scale),
        n.ADD_TO_CART: raw_ratio(c("AddtoCart"), c("UV"), scale),
    })


def relabel(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(labels))


def to_front(df: DataFrame, column: str) -> DataFrame:
    return df.select(column, *[f"`{c}`" for c in df.columns if c != column])


def to_ends(df: DataFrame, first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """Columns ``first`` in front and ``last`` behind all others, those that are there.

    For rows about to be shuffled: what neighbouring rows have alike compresses to little if it stands
    together, and before texts of any length, which move all that follows them.
    """
    front, back = ([c for c in columns if c in df.columns] for columns in (first, last))
    return df.select(*[f"`{c}`" for c in (*front, *[c for c in df.columns if c not in (*front, *back)], *back)])
