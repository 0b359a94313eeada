"""Sums over many date ranges from running totals.

A running-total table has, per key and day, the sums of all days up to it. A range
is then the difference of two of its rows, whatever its length, so a table of
ranges costs two look-ups a range and key instead of a pass over the facts.

The table is built from daily sums, not from facts: the windows that add days
up see one row per key and day. It is dense from a key's first day to the last
day of the table, so that both look-ups are plain equalities on key and day. Store
it (``write_result``, partitioned by month if need be) and refresh it with the facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from spendscope.operators.rollup import sum_by

LAST_DAY = "last_day"


@dataclass(frozen=True)
class RunningTotals:
    """``rows``: (keys, Date, running sums); ``keys`` may be empty."""

    rows: DataFrame
    keys: tuple[str, ...]
    measures: tuple[str, ...]


def running_totals(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> RunningTotals:
    """Running totals of daily sums per key; rows without a day or a key take no part.

    Without keys, the days of the whole table are one window of as many rows as
    there are days.
    """
    present = df.where(F.col("Date").isNotNull())
    for k in keys:
        present = present.where(F.col(f"`{k}`").isNotNull())
    daily = sum_by(present, [*keys, "Date"], measures)
    of_key = Window.partitionBy(*keys).orderBy("Date")
    upto = of_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = daily.withColumns({m: F.sum(f"`{m}`").over(upto) for m in measures}).withColumn("next", F.lead("Date").over(of_key))
    last = daily.agg(F.max("Date").alias(LAST_DAY))
    # a day without rows has the totals of the day before
    until = F.greatest(F.coalesce(F.date_sub("next", 1), F.col(LAST_DAY)), F.col("Date"))
    filled = rows.crossJoin(last).withColumn("Date", F.explode(F.sequence("Date", until)))
    return RunningTotals(filled.select(*[f"`{k}`" for k in keys], "Date", *[f"`{m}`" for m in measures]), tuple(keys), tuple(measures))


def range_sums(totals: RunningTotals, ranges: DataFrame, by: Sequence[str] = ("first", "last")) -> DataFrame:
    """Sums per row of ``by`` columns over all ranges and keys that share it, 0 where there is nothing.

    ``ranges`` has ``first`` and ``last`` (inclusive dates), the columns of ``by``
    and, where the totals have keys, theirs. A range looks up the day before it
    and its last day, or the table's last day if that is earlier, in one join; a
    range that ends before it begins sums to 0. Rows alike in ``by`` add up.
    """
    keys, measures = totals.keys, totals.measures
    last = totals.rows.agg(F.max("Date").alias(LAST_DAY))
    # left where the table is empty: then nothing is found, and every range sums to 0
    asked = ranges.crossJoin(last).where(F.col("first").isNotNull() & F.col("last").isNotNull())
    valid = F.col("first") <= F.col("last")
    ends = F.array(
        F.struct(F.when(valid, F.least("last", LAST_DAY)).alias("Date"), F.lit(1.0).alias("sign")),
        F.struct(F.when(valid, F.least(F.date_sub("first", 1), LAST_DAY)).alias("Date"), F.lit(-1.0).alias("sign")))
    wanted = list(dict.fromkeys([*by, *keys]))
    ends = asked.select(*[F.col(f"`{c}`").alias(f"asked {c}") for c in wanted], F.explode(ends).alias("end"))
    found = totals.rows.select(*[F.col(f"`{k}`").alias(f"held {k}") for k in keys], F.col("Date").alias("held Date"), *[f"`{m}`" for m in measures])
    same = F.col("held Date") == F.col("end.Date")
    for k in keys:
        same = same & (F.col(f"held {k}") == F.col(f"asked {k}"))
    joined = ends.join(found, same, "left")
    difference = {m: F.coalesce(F.sum(F.col(f"`{m}`") * F.col("end.sign")), F.lit(0.0)) for m in measures}
    summed = joined.groupBy(*[F.col(f"`asked {c}`").alias(c) for c in by]).agg(*[x.alias(m) for m, x in difference.items()])
    return summed


def sliding_ranges(days: DataFrame, length: int) -> DataFrame:
    """A range of ``length`` days from every day of a table (Date) on."""
    first = days.where(F.col("Date").isNotNull()).select(F.col("Date").alias("first")).distinct()
    return first.withColumn("last", F.date_add("first", length - 1))
