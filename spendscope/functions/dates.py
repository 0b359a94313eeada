"""Calendar expressions. Ranges are inclusive on both ends."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from spendscope import names as n


def as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def within(day: Column, first: date | str, last: date | str) -> Column:
    return day.between(F.lit(as_date(first)), F.lit(as_date(last)))


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def range_label(first: date | str, last: date | str) -> str:
    return f"{as_date(first).isoformat()}{n.RANGE_JOINER}{as_date(last).isoformat()}"


def range_divisor(first: date | str, last: date | str) -> Column:
    """Days from first to last: one less than the days the range holds."""
    return F.datediff(F.lit(as_date(last)), F.lit(as_date(first))).cast("double")


def monthly_to_daily(value: Column, month: Column) -> Column:
    """Month value spread over the days of its month.

    Only months of the covered calendar are spread; others stay as they are.
    """
    covered = within(month, n.MEAN_FIRST_MONTH, n.MEAN_LAST_MONTH) & (F.dayofmonth(month) == 1)
    return F.when(covered, F.try_divide(value, F.dayofmonth(F.last_day(month)).cast("double"))).otherwise(value)
