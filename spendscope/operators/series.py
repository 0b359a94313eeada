"""Ordered per-SKU series of the campaign page.

``daily_points`` adds rows up per product, day and cost per click, which is the
form for further work. ``sku_series`` is the page's table: one row per product
with twelve aligned list columns, ordered by day, then cost per click.
``day_series`` has the same lists cut by day, for products whose whole history is
too long for a cell: the points of a product and day are bounded by its campaigns.

Lists are built in two levels. The points of a product and day are sorted where
they meet, so a product that holds a large share of all rows is dealt out by day;
then its days, each with a sorted list, are put in order and joined end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.dates import iso
from spendscope.operators.rollup import group_sum, total

PRODUCT = ("SKU", "SPU", n.PT3, n.GENERATION, n.PRICE, "image")
POINT_MEASURES = ("cost", "clicks", "Impression", "GMV", "UV", "value", "conversion", "sale",
                  "saleuser", "AddtoCart")
SERIES = (n.CPC, *POINT_MEASURES)


def daily_points(rows: DataFrame) -> DataFrame:
    return group_sum(rows, [*PRODUCT, "Date", n.CPC], POINT_MEASURES)


def product_totals(rows: DataFrame) -> DataFrame:
    """Cost and GMV of a product over all its rows."""
    return (
        group_sum(rows, PRODUCT, ["cost", "GMV"])
        .withColumnsRenamed({"cost": "cost_sum", "GMV": "gmv_sum"})
    )


def _days(points: DataFrame) -> DataFrame:
    """One row per product and day: its points by rising cost per click, and its sums."""
    entry = F.struct(n.CPC, *POINT_MEASURES)
    return points.groupBy(*PRODUCT, "Date").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), total("GMV").alias("day_gmv"), total("cost").alias("day_cost"))


def sku_series(points: DataFrame) -> DataFrame:
    """One row per product: aligned lists of all its points by day and cost per click, with its totals.

    Days are ISO text in their list.
    """
    series = _days(points).groupBy(*PRODUCT).agg(
        F.sort_array(F.collect_list(F.struct("Date", "entries"))).alias("days"),
        total("day_gmv").alias("gmv_sum"), total("day_cost").alias("cost_sum"))
    dates = F.flatten(F.transform("days", lambda d: F.array_repeat(iso(d["Date"]), F.size(d["entries"]))))
    joined = series.withColumns({"dates": dates, "entries": F.flatten(F.col("days.entries"))})
    lists = {c: F.col("entries").getField(c) for c in SERIES}
    shown = [lists[n.CPC].alias(n.CPC), F.col("dates").alias("Date"), *[lists[c].alias(c) for c in POINT_MEASURES]]
    return joined.select(*[f"`{c}`" for c in PRODUCT], *shown, "gmv_sum", "cost_sum")


def day_series(points: DataFrame) -> DataFrame:
    """List columns per product and day, with totals of the product over all its days.

    Both sides of the join start from the same day rows, so their shuffle is
    run once and used twice.
    """
    days = _days(points)
    totals = days.groupBy(*PRODUCT).agg(
        total("day_gmv").alias("gmv_sum"), total("day_cost").alias("cost_sum"), F.sum(F.size("entries")).alias("points"))
    return days.join(totals, list(PRODUCT)).select(
        *[f"`{c}`" for c in PRODUCT], "Date", *[F.col("entries").getField(c).alias(c) for c in SERIES],
        "gmv_sum", "cost_sum", "points",
    )
