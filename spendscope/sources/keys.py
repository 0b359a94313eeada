"""Key lists: a few keys as Python values, or any number as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Keys = Sequence[str] | DataFrame


def keys_from_text(spark: SparkSession, text: str, name: str) -> DataFrame:
    """One key per line of a typed text; empty text is one empty key."""
    return spark.range(1).select(F.explode(F.split(F.lit(text), "\n", -1)).alias(name))


def keys_from_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One key per line of a text file of any size."""
    return spark.read.text(path).select(F.col("value").alias(name))


def restrict(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """Rows whose ``column`` is among the keys."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(f"`{keys.columns[0]}`").alias(column))
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(f"`{column}`").isin(*keys))



def without(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """Rows whose ``column`` is not among the keys; a missing value is among none."""
    if isinstance(keys, DataFrame):
        unwanted = keys.select(F.col(f"`{keys.columns[0]}`").alias(column))
        return df.join(unwanted, column, "left_anti")
    return df.where(F.col(f"`{column}`").isNull() | ~F.col(f"`{column}`").isin(*keys)) if keys else df
