"""Straight-line trends from sums that merge.

The least-squares slope needs no more than the number of points and the sums of
x, y, x*y and x*x. Each is a sum, so partial aggregates of any cut of the rows
add up to them, in one pass and one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_number(month: Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return (F.year(month) * 12 + F.month(month)).cast("double")


def slope(points: Column, x: Column, y: Column, xy: Column, xx: Column) -> Column:
    """Slope of the fitted line; missing for fewer than two different x."""
    spread = points * xx - x * x
    return F.when(spread > 0, F.try_divide(points * xy - x * y, spread))


def slope_of(x: Column, y: Column) -> Column:
    """Aggregate: slope over the rows that have both values."""
    both = x.isNotNull() & y.isNotNull()
    at, value = F.when(both, x), F.when(both, y)
    return slope(F.count(at).cast("double"), F.sum(at), F.sum(value), F.sum(at * value), F.sum(at * at))


def slope_with_gaps(number: Column, y: Column, first: int, last: int) -> Column:
    """Aggregate: slope over all whole numbers first..last, those without rows counting as 0.

    Several rows of one number are added up. Counted from the middle of the range, x sums to 0 and
    the other sums of x are constants, so only x*y is left to add up.
    """
    points, middle = last - first + 1, (first + last) / 2
    spread = points * (points * points - 1) / 12
    if points < 2:
        return F.lit(None).cast("double")
    inside = number.between(first, last)
    return F.coalesce(F.sum(F.when(inside, (number - F.lit(middle)) * y)), F.lit(0.0)) / F.lit(spread)
