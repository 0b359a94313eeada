"""SKU pruning plan: which weak SKUs of which product families to stop paying for.

Families (SPUs) qualify by what they cost, earn and return per month, by how
many SKUs they have and by category. Within them, SKUs that cost more than the
family's mean per SKU and are still on sale are ranked, the weakest first.

All figures come from the monthly tables. Each step is an aggregate over the one
before: months to SKUs, SKUs to families; families join back to SKUs, so no
window or sort ever sees the facts, nor a family as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendscope import names as n
from spendscope.functions.dates import as_date, within
from spendscope.functions.ratios import protected_ratio, raw_ratio
from spendscope.functions.trend import month_number, slope_with_gaps
from spendscope.operators.rollup import drop_null_keys, total
from spendscope.plans.spu import ALL_MEASURES, folded_rows
from spendscope.sources.keys import Keys, without

Day = date | str


@dataclass(frozen=True)
class Rules:
    """The plan's thresholds; a bound itself does not qualify but for ``least_skus``."""

    months: tuple[Day, Day] = n.PRUNING_MONTHS
    return_months: tuple[Day, Day] = n.PRUNING_RETURN_MONTHS
    trend_months: tuple[Day, Day] = n.PRUNING_TREND_MONTHS
    cost_above: float = n.PRUNING_COST_ABOVE
    gmv_below: float = n.PRUNING_GMV_BELOW
    return_below: float = n.PRUNING_RETURN_BELOW
    least_skus: int = n.PRUNING_LEAST_SKUS
    categories: tuple[str, ...] = n.PRUNING_CATEGORIES
    left_out: tuple[str, ...] = n.PRUNING_LEFT_OUT


def months_between(first: Day, last: Day) -> int:
    """Months of an inclusive range of first days of months."""
    first, last = as_date(first), as_date(last)
    return (last.year - first.year) * 12 + last.month - first.month + 1


def _any(test: Column) -> Column:
    return F.coalesce(F.max(test), F.lit(False))


def _number(day: Day) -> int:
    return as_date(day).year * 12 + as_date(day).month


def sku_months(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, rules: Rules = Rules(), spus: Keys | None = None
) -> DataFrame:
    """Sums per SPU, SKU, category and month of the plan's year."""
    rows = folded_rows(ads, sensor, spu, label, monthly=True, dates=rules.months, spus=spus)
    keys = ["SPU", "SKU", n.PT3, "Month"]
    return drop_null_keys(rows, keys).groupBy(*keys).agg(*[total(m).alias(m) for m in ALL_MEASURES])


def sku_figures(monthly: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per SPU and SKU: sums of the year, of the months that the return is taken over, and both trends.

    Trends are slopes per month over ``trend_months``; a month without rows counts as 0.
    """
    span = _number(rules.trend_months[0]), _number(rules.trend_months[1])
    number = month_number(F.col("Month"))
    trend = lambda m: slope_with_gaps(number, F.col(f"`{m}`"), *span)
    returned = within(F.col("Month"), *rules.return_months)
    wanted = F.lower(F.trim(n.PT3)).isin(*[c.lower() for c in rules.categories])
    return monthly.groupBy("SPU", "SKU").agg(
        *[total(m).alias(m) for m in ALL_MEASURES],
        total(F.when(returned, F.col("cost"))).alias("return_cost"), total(F.when(returned, F.col("GMV"))).alias("return_gmv"),
        _any(wanted).alias("in_category"), trend("GMV").alias("gmv_trend"), trend("ads value").alias("ads_value_trend"))


def spu_qualification(figures: DataFrame, rules: Rules = Rules(), departments: DataFrame | None = None) -> DataFrame:
    """One row per SPU with its figures, each rule's outcome and ``qualified``.

    ``departments`` tells the first-level category of SKUs (SKU, Product Type 1); a
    family with a SKU of a category left out does not qualify.
    """
    if departments is None:
        figures = figures.withColumn("left_out", F.lit(False))
    else:
        out = departments.where(F.lower(F.trim(n.PT1)).isin(*[c.lower() for c in rules.left_out])).select("SKU").distinct()
        figures = figures.join(out.withColumn("left_out", F.lit(True)), "SKU", "left")
    months = float(months_between(*rules.months))
    # figures have one row per SKU, so counting rows counts distinct SKUs
    family = figures.groupBy("SPU").agg(
        F.count("*").alias("sku_count"), (total("cost") / F.lit(months)).alias("mean_cost"), (total("GMV") / F.lit(months)).alias("mean_gmv"),
        protected_ratio(total("return_gmv"), total("return_cost")).alias("return"),
        _any(F.col("in_category")).alias("in_category"), _any(F.col("left_out")).alias("left_out"))
    tests = {
        "costs_enough": F.col("mean_cost") > rules.cost_above, "earns_little": F.col("mean_gmv") < rules.gmv_below,
        "returns_little": F.col("return") < rules.return_below, "has_skus": F.col("sku_count") >= rules.least_skus,
    }
    qualified = F.col("in_category") & ~F.col("left_out")
    for name in tests:
        qualified = qualified & F.col(name)
    return family.withColumns(tests).withColumn("qualified", qualified)


def above_family_share(figures: DataFrame, families: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """SKUs with their mean monthly cost, the family's mean per SKU and whether the first is above the second.

    The families' figures join back to their SKUs; adaptive execution splits a family that holds many.
    """
    share = families.select("SPU", F.try_divide(F.col("mean_cost"), F.col("sku_count").cast("double")).alias("family_share"))
    cost = F.col("cost") / F.lit(float(months_between(*rules.months)))
    joined = figures.join(share, "SPU").withColumn("sku_mean_cost", cost)
    return joined.withColumn("above_share", F.col("sku_mean_cost") > F.col("family_share"))


PRIORITY = ("sensor_roi", "ads_roi", "gmv_trend", "ads_value_trend", "ctr")


def with_priorities(figures: DataFrame) -> DataFrame:
    """The figures that decide the order: returns, trends and CTR."""
    return figures.withColumns({
        "sensor_roi": protected_ratio(F.col("GMV"), F.col("cost")), "ads_roi": protected_ratio(F.col("`ads value`"), F.col("cost")),
        "ctr": raw_ratio(F.col("click"), F.col("impression"))})


def weakest(skus: DataFrame, most: int = 3, by: Sequence[str] = PRIORITY) -> DataFrame:
    """The ``most`` weakest SKUs of each SPU with their ``rank``: lowest on the first figure, ties by the next ones, then by SKU.

    A missing figure comes after all others. For up to 1,000 the optimiser keeps
    ``most`` rows per SPU in every task before they meet, so a large family is never sorted whole.
    """
    order = [*[F.asc_nulls_last(c) for c in by], F.asc("SKU")]
    rank = F.row_number().over(Window.partitionBy("SPU").orderBy(*order))
    return skus.withColumn("rank", rank).where(F.col("rank") <= most)


def pruning_plan(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, rules: Rules = Rules(), departments: DataFrame | None = None,
    delisted: Keys | None = None, most: int = 3,
) -> DataFrame:
    """The SKUs to stop paying for, ranked within their SPU."""
    figures = sku_figures(sku_months(ads, sensor, spu, label, rules), rules)
    families = spu_qualification(figures, rules, departments).where("qualified")
    chosen = above_family_share(figures, families, rules).where("above_share")
    if delisted is not None:
        chosen = without(chosen, "SKU", delisted)
    shown = ["SPU", "SKU", "rank", "sku_mean_cost", "family_share", *PRIORITY]
    return weakest(with_priorities(chosen), most).select(*shown)
