"""Campaign page: ordered series per SKU and the campaigns of a range."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.dates import within
from spendscope.functions.ratios import protected_ratio
from spendscope.operators.cleaning import CAMPAIGN, clean_ads
from spendscope.operators.enrich import (
    CAMPAIGN_DEAL,
    enrich_campaign,
    fill_missing,
    fold_enriched,
    normalise_index,
)
from spendscope.operators.rollup import distinct_values, drop_null_keys
from spendscope.operators.series import daily_points, day_series, sku_series
from spendscope.sources.keys import Keys, restrict

Day = date | str


def enriched_rows(ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame) -> DataFrame:
    """Every campaign row joined with products and sensor facts, filled; ``enrich.presented`` sorts them."""
    return enrich_campaign(clean_ads(ads, CAMPAIGN, dealt_by=CAMPAIGN_DEAL), label, sensor, normalise_index(spu))


def _chosen(df: DataFrame, first: Day, last: Day, campaigns: Keys | None) -> DataFrame:
    df = df.where(within(F.col("Date"), first, last))
    return df if campaigns is None else restrict(df, "Campaign", campaigns)


def folded_rows(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    label: DataFrame,
    first: Day,
    last: Day,
    campaigns: Keys | None = None,
) -> DataFrame:
    """Folded campaign rows of a range, filled, with their cost per click."""
    ads, sensor = (_chosen(df, first, last, campaigns) for df in (ads, sensor))
    # the ratio is taken before folding: rows that share it must share every bit of it
    cleaned = clean_ads(ads, CAMPAIGN, dealt_by=CAMPAIGN_DEAL).withColumn(n.CPC, protected_ratio(F.col("cost"), F.col("clicks")))
    rows = fold_enriched(
        cleaned, label, sensor, normalise_index(spu), keys=CAMPAIGN_DEAL,
        ads_measures=n.CAMPAIGN_ADS_MEASURES, sensor_measures=n.CAMPAIGN_SENSOR_MEASURES,
        generation=True, attributes=(n.PRICE, "imagelink"), sensor_by_products=False, sensor_first=True,
    )
    return fill_missing(rows.withColumnRenamed("imagelink", "image"))


def campaign_points(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, first: Day, last: Day,
    campaigns: Keys | None = None,
) -> DataFrame:
    """Series points in long form: one row per product, day and cost per click."""
    return daily_points(folded_rows(ads, sensor, spu, label, first, last, campaigns))


def campaign_series(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, first: Day, last: Day,
    campaigns: Keys | None = None,
) -> DataFrame:
    """Series as list columns, one row per product, with the product's cost and GMV totals."""
    return sku_series(campaign_points(ads, sensor, spu, label, first, last, campaigns))


def campaign_day_series(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, first: Day, last: Day,
    campaigns: Keys | None = None,
) -> DataFrame:
    """The same lists cut by day: one row per product and day."""
    return day_series(campaign_points(ads, sensor, spu, label, first, last, campaigns))


def campaigns_in_range(ads: DataFrame, first: Day, last: Day) -> DataFrame:
    """Campaigns with cleaned ads rows in the range.

    The left joins of the page keep every ads row, so none of them is needed.
    """
    rows = drop_null_keys(ads.where(within(F.col("Date"), first, last)), CAMPAIGN.keys)
    return distinct_values(rows, "Campaign")
