"""SKU page: period summary under campaign conditions, comparison, cost matrix.

Inputs are the raw sheets; sparse rows are dropped here. The SPU index is taken
as it is, without SKU normalisation.

Facts are added up per SKU before they meet the index or each other, so a SKU
that dominates a table is one row per period by then. Both periods of a
comparison come from one pass over each fact.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.conditions import Condition
from spendscope.functions.dates import within
from spendscope.functions.ratios import protected_ratio, raw_ratio
from spendscope.operators import compare
from spendscope.operators.cleaning import SKU_DAILY, clean_ads
from spendscope.operators.compare import BASE, COMPARE, Range, tag_periods
from spendscope.operators.enrich import count_copies
from spendscope.operators.day_vectors import day_vectors
from spendscope.operators.matrix import day_matrix
from spendscope.operators.rollup import drop_null_keys, group_sum, relabel, total
from spendscope.sources.keys import Keys, restrict
from spendscope.sources.tables import drop_sparse_rows

PRODUCT_TYPES = (n.PT1, n.PT2, n.PT3)


def _dense_ads(ads: DataFrame) -> DataFrame:
    """Ads sheet without sparse rows; rows without a merge key go while cleaning."""
    return drop_sparse_rows(ads, present=SKU_DAILY.sheet_keys)


def _dense_sensor(sensor: DataFrame) -> DataFrame:
    """Sensor sheet without sparse rows; rows without SKU or date go while adding up."""
    return drop_sparse_rows(sensor, present=("SKU", "Date"))


def sensor_summary(
    sensor: DataFrame,
    spu: DataFrame,
    periods: Mapping[str, Range],
    skus: Keys | None = None,
    condition: Condition = Condition(),
    filter_compare: bool = False,
) -> DataFrame:
    """Sensor sums and rates per period, SKU and SPU; SKUs without an SPU drop out.

    A condition without a SKU list restricts the base period only, unless
    ``filter_compare`` asks for the symmetric form. ``copies`` counts the index
    rows behind a (SKU, SPU).
    """
    rows = sensor if skus is None else restrict(sensor, "SKU", skus)
    rows = tag_periods(rows, periods)
    if condition:
        wanted = condition.on(F.col("Campaign"))
        if skus is None and not filter_compare:
            wanted = wanted | (F.col("period") != BASE)
        rows = rows.where(wanted)
    sums = group_sum(rows, ["period", "SKU"], n.CAMPAIGN_SENSOR_MEASURES)
    products = count_copies(spu.where(F.col("SPU").isNotNull()), ["SPU"], "spu").drop("spu_rows")
    joined = sums.join(products, "SKU").withColumnRenamed("spu_copies", "copies")
    repeated = joined.withColumns({m: F.col(m) * F.col("copies") for m in n.CAMPAIGN_SENSOR_MEASURES})
    return repeated.withColumns({
        n.CONVERSION: raw_ratio(F.col("saleuser"), F.col("UV")),
        n.ADD_TO_CART: raw_ratio(F.col("AddtoCart"), F.col("UV")),
    })


def period_rows(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    periods: Mapping[str, Range],
    skus: Keys | None = None,
    condition: Condition = Condition(),
    filter_compare: bool = False,
) -> DataFrame:
    """SKU summary rows of every period (``period``)."""
    ads, sensor, spu = _dense_ads(ads), _dense_sensor(sensor), drop_sparse_rows(spu)
    behaviour = sensor_summary(sensor, spu, periods, skus, condition, filter_compare)
    # a missing rate leaves a SKU out, an infinite one does not
    behaviour = drop_null_keys(behaviour, [n.CONVERSION, n.ADD_TO_CART])
    cleaned = tag_periods(clean_ads(ads, SKU_DAILY, merge=False), periods)
    if isinstance(skus, DataFrame):
        cleaned = restrict(cleaned, "SKU", skus)
    spend = group_sum(cleaned, ["period", "SKU", *PRODUCT_TYPES, n.GENERATION], n.ADS_MEASURES)
    # the index multiplies ads rows exactly as it multiplied the sensor rows
    rows = spend.join(behaviour, ["period", "SKU"])
    rows = rows.withColumns({m: F.col(m) * F.col("copies") for m in n.ADS_MEASURES}).drop("copies")
    rows = rows.withColumns({
        n.SENSOR_ROI: protected_ratio(F.col("GMV"), F.col("cost")),
        n.ADS_ROI: protected_ratio(F.col("ads value"), F.col("cost")),
        n.CPC: protected_ratio(F.col("cost"), F.col("click")),
        n.CTR: raw_ratio(F.col("click"), F.col("impression")),
    })
    return relabel(rows, n.SKU_REPORT_LABELS)


def period_summary(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    first: date | str,
    last: date | str,
    skus: Keys | None = None,
    condition: Condition = Condition(),
) -> DataFrame:
    """SKU summary of one period."""
    return period_rows(ads, sensor, spu, {BASE: (first, last)}, skus, condition).drop("period")


def compared_totals(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    base: Range,
    other: Range,
    skus: Keys | None = None,
    condition: Condition = Condition(),
    filter_compare: bool = False,
) -> DataFrame:
    """Totals of two periods as two rows."""
    periods = {BASE: base, COMPARE: other}
    rows = period_rows(ads, sensor, spu, periods, skus, condition, filter_compare)
    return compare.period_totals(rows, periods)


def compare_periods(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    base: Range,
    other: Range,
    skus: Keys | None = None,
    condition: Condition = Condition(),
    filter_compare: bool = False,
) -> DataFrame:
    """Totals of two periods and their relative change, as three rows."""
    totals = compared_totals(ads, sensor, spu, base, other, skus, condition, filter_compare)
    return compare.with_change_row(totals)


def _daily_costs(ads: DataFrame, spu: DataFrame, skus: Keys, dates: Range | None) -> DataFrame:
    """Cost per SKU and day, repeated by the index rows of the SKU."""
    ads = _dense_ads(ads)
    if dates:
        ads = ads.where(within(F.col("Date"), *dates))
    # merging matters only where repeated cells are to be refused
    rows = restrict(clean_ads(ads, SKU_DAILY, merge=False), "SKU", skus)
    sums = rows.groupBy("SKU", "Date").agg(total("cost").alias("cost"))
    copies = count_copies(drop_sparse_rows(spu), [], "spu")
    return sums.join(copies, "SKU", "left").withColumn("cost", F.col("cost") * F.coalesce(F.col("spu_copies"), F.lit(1.0)))


def sku_cost_matrix(
    ads: DataFrame,
    spu: DataFrame,
    skus: Keys,
    first: date | str,
    last: date | str,
    strict: bool = False,
) -> DataFrame:
    """Daily cost per SKU of the chosen SKUs."""
    if strict:
        chosen = _dense_ads(ads).where(within(F.col("Date"), first, last))
        rows = restrict(clean_ads(chosen, SKU_DAILY, merge=True), "SKU", skus)
        return day_matrix(rows.join(spu.select("SKU"), "SKU", "left"), ["SKU"], first, last, strict=True)
    return day_matrix(_daily_costs(ads, spu, skus, (first, last)), ["SKU"], first, last)


def sku_cost_vectors(ads: DataFrame, spu: DataFrame, skus: Keys, dates: Range | None = None) -> DataFrame:
    """The same as sparse day vectors, over a range or over all days."""
    return day_vectors(_daily_costs(ads, spu, skus, dates), ["SKU"])


def with_custom_labels(summary: DataFrame, ads_labels: DataFrame) -> DataFrame:
    """Summary rows once per pair of custom labels that their SKU carries.

    Only fully labelled SKUs stay. Summary rows are unique, so distinct labels
    already give one row per combination.
    """
    columns = ["SKU", "customlabel2", "customlabel4"]
    labels = drop_null_keys(ads_labels.select(*columns), columns).distinct()
    return summary.join(labels, "SKU")
