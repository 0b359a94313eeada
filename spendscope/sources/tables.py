"""Readers of sheet exports and the sinks of results.

A table is described by its declared schema and by the sheet headers that
differ from the canonical names. Parquet is the format for large facts: it
prunes columns and pushes filters; CSV serves plain sheet exports.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from spendscope import names as n, schemas as s


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    headers: Mapping[str, str] = field(default_factory=dict)


ADS_DAILY = Table(s.ADS_DAILY)
ADS_SKU_DAILY = Table(s.ADS_SKU_DAILY)
ADS_CAMPAIGN_DAILY = Table(s.ADS_CAMPAIGN_DAILY, n.LABEL_HEADERS)
ADS_MONTHLY = Table(s.ADS_MONTHLY)
SENSOR_DAILY = Table(s.SENSOR_DAILY, n.SENSOR_DAILY_HEADERS)
SENSOR_CAMPAIGN_DAILY = Table(s.SENSOR_CAMPAIGN_DAILY, n.SENSOR_CAMPAIGN_HEADERS)
SENSOR_MONTHLY = Table(s.SENSOR_MONTHLY, n.SENSOR_MONTHLY_HEADERS)
SPU_INDEX = Table(s.SPU_INDEX)
PRODUCT_LABEL = Table(s.PRODUCT_LABEL, n.LABEL_HEADERS)
SPU_REGISTER = Table(s.SPU_REGISTER)


def canonical(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Rename localised headers to canonical names; absent ones are skipped."""
    return df.withColumnsRenamed(dict(headers))


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Canonical names, declared types, declared columns only.

    A value that is not of its declared type (a malformed date, say) fails the
    job rather than turning into a silent null.
    """
    named = canonical(df, table.headers)
    return named.select(*[number_or_missing(F.col(f"`{c.name}`").cast(c.dataType), c.dataType).alias(c.name) for c in table.schema.fields])


def number_or_missing(column: Column, kind: T.DataType) -> Column:
    """Not-a-number is a missing value, as one such cell would spoil every sum above it."""
    return F.nanvl(column, F.lit(None)) if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def loader(spark: SparkSession, fmt: str, line_feeds: bool) -> DataFrameReader:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # headers decide which column is which, so exports may order them freely
        reader = reader.option("header", True).option("multiLine", line_feeds)
    return reader


def read_table(spark: SparkSession, table: Table, path: str, fmt: str = "parquet", line_feeds: bool = False) -> DataFrame:
    """One logical table from a Parquet or CSV export, found by column name.

    ``line_feeds`` says that cells of a CSV export hold line feeds; such a file
    cannot be split over tasks.
    """
    return conform(loader(spark, fmt, line_feeds).load(path), table)


def read_sheet(spark: SparkSession, path: str, fmt: str = "parquet", line_feeds: bool = False) -> DataFrame:
    """A sheet with all its own columns, as it is but for not-a-number, which is missing."""
    df = loader(spark, fmt, line_feeds).load(path)
    return df.select(*[number_or_missing(F.col(f"`{c.name}`"), c.dataType).alias(c.name) for c in df.schema.fields])


def drop_sparse_rows(df: DataFrame, missing: int = 2, present: Sequence[str] = ()) -> DataFrame:
    """Keep rows that lack at most ``missing`` of the sheet's columns.

    Name in ``present`` the columns that always hold a value, or whose empty
    rows are dropped anyway: they cannot tip the count, and the optimiser
    handles a test over few columns far faster than one over all.
    """
    counted = [c for c in df.columns if c not in present]
    if len(counted) <= missing:
        return df
    return df.na.drop(thresh=len(counted) - missing, subset=counted)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(f"`{column}`").isNotNull())


def write_result(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Store a result; executors write their own parts.

    Facts that many reports share are best written partitioned by a month
    column, so that date filters skip whole folders.
    """
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # blanks around a value are part of it
        writer = writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
