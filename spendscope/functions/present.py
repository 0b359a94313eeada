"""Report text of numbers. Numeric columns stay the contract; this is a view."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def _with_inf(x: Column, text: Column, tail: str = "") -> Column:
    return (
        F.when(x == float("inf"), "inf" + tail)
        .when(x == float("-inf"), "-inf" + tail)
        .otherwise(text)
    )


def _hundredths(x: Column) -> Column:
    # rounds the exact binary value, ties to even
    return F.call_function("format_number", x, F.lit("0.00"))


def two_decimals(x: Column) -> Column:
    return F.when(x.isNotNull(), _with_inf(x, _hundredths(x)))


def percent(x: Column) -> Column:
    return F.when(x.isNotNull(), _with_inf(x, F.concat(_hundredths(x * 100), F.lit("%")), "%"))


def as_is(x: Column) -> Column:
    """Shortest decimal text without exponent; whole numbers keep one decimal."""
    # shortest digits that name the double, as many places as a double can have; 0.0 added turns -0.0 into 0.0
    text = F.call_function("format_number", x + 0.0, F.lit("0.0" + "#" * 330))
    return F.when(x.isNotNull(), _with_inf(x, text))


STYLES = {"2": two_decimals, "%": percent, "r": as_is}


def as_text(df: DataFrame, layout: Mapping[str, str]) -> DataFrame:
    """Replace the columns of ``layout`` that ``df`` has by their report text."""
    return df.withColumns({c: STYLES[s](F.col(c)) for c, s in layout.items() if c in df.columns})
