"""Reading with broken rows set aside.

The strict reader fails on the first value that is not of its declared type. The checked
one gives two frames: rows whose values are all of their types, and the others as
they came, with their file and what is wrong with them. Each source row is in exactly one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spendscope.sources.tables import Table, canonical, loader, number_or_missing

FILE, REASON, RAW = "file", "reason", "raw"


@dataclass(frozen=True)
class Checked:
    good: DataFrame
    rejects: DataFrame  # file, reason, raw (column -> text)


def _blank(column: Column, kind: T.DataType) -> Column:
    """A cell of blanks is a missing value, except in text."""
    return F.when(F.trim(column.cast("string")) != "", column) if not isinstance(kind, T.StringType) else column


def read_checked(spark: SparkSession, table: Table, path: str, fmt: str = "parquet", line_feeds: bool = False, required: tuple[str, ...] = ()) -> Checked:
    """Good rows and rejects of a Parquet or CSV export.

    A row is rejected for every declared column whose value is there but is not of its
    declared type, and for every ``required`` column without a value. A declared column
    that the export lacks is an error, not a reject.
    """
    if fmt == "csv":
        names = canonical(loader(spark, fmt, line_feeds).load(path), table.headers).columns
        sheet = loader(spark, fmt, line_feeds).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).load(path)
    else:
        sheet = canonical(loader(spark, fmt, line_feeds).load(path), table.headers)
    fields = table.schema.fields
    cells = {f.name: _blank(F.col(f"`{f.name}`"), f.dataType) for f in fields}
    typed = {f.name: cells[f.name].try_cast(f.dataType) for f in fields}
    broken = [F.when(cells[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in fields]
    broken += [F.when(cells[name].isNull(), F.lit(f"{name} is missing")) for name in required]
    reasons = F.array_join(F.array_compact(F.array(*broken)), "; ")
    judged = sheet.select(
        F.col("_metadata.file_name").alias("source file"), reasons.alias("what is wrong"),
        F.map_from_arrays(F.array(*[F.lit(f.name) for f in fields]), F.array(*[F.col(f"`{f.name}`").cast("string") for f in fields])).alias("as it came"),
        *[number_or_missing(typed[f.name], f.dataType).alias(f.name) for f in fields])
    good = judged.where(F.col("what is wrong") == "").select(*[f"`{f.name}`" for f in fields])
    rejects = judged.where(F.col("what is wrong") != "").select(F.col("source file").alias(FILE), F.col("what is wrong").alias(REASON), F.col("as it came").alias(RAW))
    return Checked(good, rejects)


def reject_counts(checked: Checked) -> DataFrame:
    """Rows per reason, several reasons of a row counting each; good rows under no reason."""
    bad = checked.rejects.select(F.explode(F.split(REASON, "; ")).alias(REASON))
    return checked.good.select(F.lit(None).cast("string").alias(REASON)).unionByName(bad).groupBy(REASON).agg(F.count("*").alias("rows"))
