"""Cleaning of ads rows: identifier repair, currency, merge of repeated rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spendscope import names as n
from spendscope.functions import text
from spendscope.operators.rollup import drop_null_keys, group_sum, sum_by, to_ends


@dataclass(frozen=True)
class AdsShape:
    """What differs between the ads sheets of the pages."""

    keys: tuple[str, ...]
    measures: tuple[str, ...] = n.ADS_MEASURES
    currency: str = "Currency"
    money: tuple[str, ...] = ("cost", "ads value")
    fx_rate: float = n.FX_RATE
    labelled: bool = False

    @property
    def internal(self) -> tuple[str, ...]:
        """Keys that separate rows while merging but are not kept."""
        return ("MC ID", self.currency, "Country")

    @property
    def sheet_keys(self) -> tuple[str, ...]:
        """Keys as the sheet has them. No row rule turns a value into a missing
        one or back, except that a listing always gets a generation."""
        return tuple(k for k in self.keys if k != n.GENERATION)


DAILY = AdsShape(keys=("SKU", "MC ID", "Date", "Currency", n.PT3, "Country"))
MONTHLY = AdsShape(keys=("SKU", "MC ID", "Month", "Currency", n.PT3, "Country"))
SKU_DAILY = AdsShape(
    keys=("SKU", "MC ID", "Date", "Currency", n.PT1, n.PT2, n.PT3, n.GENERATION, "Country"),
    fx_rate=n.FX_RATE_SKU_PAGE,
    labelled=True,
)
CAMPAIGN = AdsShape(
    keys=("Campaign", "Campaign ID", "MC ID", "SKU", "Date", "currency", n.PT3, "Country"),
    measures=n.CAMPAIGN_ADS_MEASURES,
    currency="currency",
    money=("cost", "value"),
)


def strip_merchant_suffix(df: DataFrame) -> DataFrame:
    return df.withColumn("SKU", text.merchant_sku(F.col("SKU"), F.col("MC ID")))


def remap_merchant(df: DataFrame) -> DataFrame:
    return df.withColumn("MC ID", text.main_merchant(F.col("MC ID")))


def strip_home_suffix(df: DataFrame) -> DataFrame:
    return df.withColumn("SKU", text.without_home_suffix(F.col("SKU")))


def to_report_currency(
    df: DataFrame,
    currency: str = "Currency",
    money: tuple[str, ...] = ("cost", "ads value"),
    fx_rate: float = n.FX_RATE,
) -> DataFrame:
    foreign = F.col(currency) == n.FOREIGN_CURRENCY
    converted = {m: F.when(foreign, F.col(m) * fx_rate).otherwise(F.col(m)) for m in money}
    return df.withColumns(
        converted | {currency: F.when(foreign, n.REPORT_CURRENCY).otherwise(F.col(currency))}
    )


def label_generation(df: DataFrame, source: str = "customlabel1") -> DataFrame:
    return df.withColumn(source, text.listing_generation(F.col(source))).withColumnRenamed(source, n.GENERATION)


def normalise_sku(df: DataFrame) -> DataFrame:
    """Normalised SKU of rows that have one.

    The result is declared as never missing: joins then need no null test on
    it, which would run the text functions once more on every row of the scan.
    """
    return df.withColumn("SKU", F.coalesce(text.normalise_sku(F.col("SKU")), F.lit("")))


def repair_rows(ads: DataFrame, shape: AdsShape) -> DataFrame:
    """Row rules in their fixed order; the suffix tests see the raw SKU text."""
    rows = ads.transform(strip_merchant_suffix).transform(remap_merchant).transform(strip_home_suffix)
    rows = to_report_currency(rows, shape.currency, shape.money, shape.fx_rate)
    return label_generation(rows) if shape.labelled else rows


def merge_repeats(rows: DataFrame, shape: AdsShape) -> DataFrame:
    """Sum rows that share all keys; rows with a missing key are left out."""
    return group_sum(rows, shape.keys, shape.measures)


def clean_ads(
    ads: DataFrame, shape: AdsShape, only: DataFrame | None = None, merge: bool = True, dealt_by: Sequence[str] | None = None
) -> DataFrame:
    """Cleaned ads rows.

    SKUs are normalised after merging, so one normalised SKU may keep several
    rows per day. ``only`` (normalised SKUs) cuts the facts before anything is
    shuffled; whole merge groups stay or go, as the SKU is one of their keys.
    ``merge=False`` leaves repeated rows apart: consumers that do nothing but
    add measures up get the same sums with one shuffle less.

    ``dealt_by`` names columns of the result, SKU among them, that all keys of a
    merge share. Rows are then dealt by them before they merge, and a join on them
    (in that order) needs no shuffle of the facts any more. Repeated rows meet only
    after that shuffle.
    """
    rows = repair_rows(drop_null_keys(ads, shape.sheet_keys), shape)
    if only is not None:
        wanted = only.select(F.col("SKU").alias("wanted_sku"))
        sku = F.coalesce(text.normalise_sku(rows["SKU"]), F.lit(""))
        rows = rows.join(wanted, sku == F.col("wanted_sku"), "left_semi")
    if merge and dealt_by:
        normalised = F.coalesce(text.normalise_sku(F.col("SKU")), F.lit(""))
        rows = to_ends(rows.select(*shape.keys, *shape.measures), (shape.currency, "MC ID", "SKU"), (n.PT3, "Country", "Campaign"))
        # dealt by the expression: a SKU is not shuffled twice
        rows = rows.repartition(*[normalised if k == "SKU" else k for k in dealt_by]).withColumn("normalised", normalised)
        rows = sum_by(rows, [*shape.keys, "normalised"], shape.measures)
        kept = [k for k in shape.keys if k not in shape.internal]
        return rows.select(*[F.col("normalised").alias("SKU") if k == "SKU" else k for k in kept], *shape.measures)
    if merge:
        rows = sum_by(rows, shape.keys, shape.measures)
    else:
        rows = rows.select(*shape.keys, *shape.measures)
    return rows.drop(*shape.internal).transform(normalise_sku)
