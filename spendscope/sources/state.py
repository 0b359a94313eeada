"""Merged ads rows kept up to date by deliveries.

The state is the merge of all rows delivered so far (sums per merge key and how many
rows they stand for), stored as Parquet by month. A delivery adds rows and may take
earlier ones back; its own merge is added to the state's, which is the same
as merging everything anew, as sums merge. Only the months that a delivery
touches are read and written; late rows touch old months like any others.

Deliveries are numbered. Every month remembers the last one it has taken in, so a
delivery that broke off between months can be repeated: months that have it are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendscope.operators.cleaning import AdsShape, normalise_sku, repair_rows
from spendscope.operators.rollup import drop_null_keys, total

MONTH, ROWS, APPLIED, SIGN = "month", "rows", "applied", "sign"


def delivery(added: DataFrame, taken_back: DataFrame | None = None) -> DataFrame:
    """Rows to add and rows to take back as one frame; a corrected row is its old form taken back and its new one added."""
    rows = added.withColumn(SIGN, F.lit(1))
    return rows if taken_back is None else rows.unionByName(taken_back.select(*added.columns).withColumn(SIGN, F.lit(-1)))


def _merged(rows: DataFrame, shape: AdsShape, sign: str, count: str) -> DataFrame:
    signed = [total(F.col(f"`{m}`") * F.col(sign)).alias(m) for m in shape.measures]
    return rows.groupBy(*shape.keys).agg(*signed, F.sum(count).alias(ROWS))


def merged_delivery(rows: DataFrame, shape: AdsShape) -> DataFrame:
    """The delivery's own merge: signed sums and signed row counts per merge key, with their month."""
    repaired = repair_rows(drop_null_keys(rows, shape.sheet_keys), shape)
    merged = _merged(repaired, shape, SIGN, SIGN)
    return merged.withColumn(MONTH, F.date_format(F.trunc("Date", "month"), "yyyy-MM-dd"))


def _months(df: DataFrame) -> list[str]:
    """The months of a frame: as many as the calendar has, however many rows."""
    return sorted(r[0] for r in df.select(MONTH).distinct().collect())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The state with its months as text; Spark would read them as dates otherwise."""
    return spark.read.parquet(path).withColumn(MONTH, F.date_format(F.col(MONTH).cast("date"), "yyyy-MM-dd"))


def refresh(spark: SparkSession, path: str, rows: DataFrame, shape: AdsShape, number: int) -> list[str]:
    """Take delivery ``number`` into the state at ``path``; returns the months written.

    A key whose rows have all been taken back stays with a count of 0, so that its month is
    written even if nothing is left in it; ``current`` does not show it.
    """
    change = merged_delivery(rows, shape)
    months, known = _months(change), _exists(spark, path)
    if known:
        state = _stored(spark, path).where(F.col(MONTH).isin(*months))
        done = {r[0] for r in state.where(F.col(APPLIED) >= number).select(MONTH).distinct().collect()}
        months = [m for m in months if m not in done]
    if not months:
        return []
    change = change.where(F.col(MONTH).isin(*months))
    if known:
        change = change.unionByName(state.where(F.col(MONTH).isin(*months)).drop(APPLIED))
    one = F.lit(1)
    summed = change.withColumn(SIGN, one).groupBy(*shape.keys, MONTH).agg(*[total(m).alias(m) for m in shape.measures], F.sum(ROWS).alias(ROWS))
    # a month is a folder; its rows are dealt by key, so a large month has many writers
    summed.withColumn(APPLIED, F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return months


def current(spark: SparkSession, path: str, shape: AdsShape) -> DataFrame:
    """The merged rows of all deliveries, keys as merged."""
    held = _stored(spark, path).where(F.col(ROWS) > 0)
    return held.select(*shape.keys, *shape.measures)


def cleaned(spark: SparkSession, path: str, shape: AdsShape) -> DataFrame:
    """The state as ``clean_ads`` gives it."""
    return current(spark, path, shape).drop(*shape.internal).transform(normalise_sku)
