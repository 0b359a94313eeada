"""Yearly SKU summary and its lookup by SPU."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.bands import generation_flag, roi_band
from spendscope.operators.rollup import group_sum, with_ratios
from spendscope.plans.spu import ALL_MEASURES, folded_rows
from spendscope.sources.keys import Keys, restrict

SUMMARY_KEYS = ("SPU", "SKU", n.PT3, n.GENERATION, n.PRICE)


def yearly_summary(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    label: DataFrame,
    first_month: date | str = n.YEAR_FIRST_MONTH,
    last_month: date | str = n.YEAR_LAST_MONTH,
    spus: Keys | None = None,
) -> DataFrame:
    """Sums and ratios per SKU over the months; SKUs without a price drop out.

    ``ads`` and ``sensor`` are monthly. Rows come in no order; ``by_spu`` sorts them for showing. A sort
    inside would run the sums twice, as it samples its input to deal it into ranges.
    """
    rows = folded_rows(
        ads, sensor, spu, label, monthly=True, dates=(first_month, last_month), spus=spus,
        generation=True, attributes=(n.PRICE,),
    )
    sums = with_ratios(group_sum(rows, SUMMARY_KEYS, ALL_MEASURES), sensor_roi=n.YEAR_SENSOR_ROI)
    return sums.drop(n.CPC, n.CONVERSION, n.ADD_TO_CART)


def by_spu(summary: DataFrame) -> DataFrame:
    """The summary in the order in which it is shown: by SPU, then SKU, as one SPU may hold many."""
    return summary.orderBy(F.asc_nulls_last("SPU"), F.asc_nulls_last("SKU"))


def spu_lookup(summary: DataFrame, spus: Keys) -> DataFrame:
    """SKUs of the chosen SPUs, dearest first, with ROI band and generation flag."""
    chosen = restrict(summary, "SPU", spus).withColumns({
        "roi_band": roi_band(F.col(n.YEAR_SENSOR_ROI)),
        "generation_flag": generation_flag(F.col(n.GENERATION)),
    })
    return chosen.orderBy(F.desc_nulls_last("cost"))


def spu_category(summary: DataFrame, spus: Keys) -> DataFrame:
    """Category of the first SKU of the chosen SPUs, in capitals."""
    return (
        restrict(summary, "SPU", spus)
        .orderBy("SPU", "SKU", n.PT3)
        .limit(1)
        .select(F.upper(n.PT3).alias(n.PT3))
    )
