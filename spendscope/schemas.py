"""Declared schemas of the logical tables (canonical column names)."""

from __future__ import annotations

from pyspark.sql import types as T

from spendscope import names as n


def _struct(**groups: tuple[str, ...]) -> T.StructType:
    kinds = {"text": T.StringType(), "id": T.LongType(), "day": T.DateType(), "number": T.DoubleType()}
    fields = [T.StructField(c, kinds[kind]) for kind, columns in groups.items() for c in columns]
    return T.StructType(fields)


ADS_DAILY = _struct(
    text=("SKU", "Currency", n.PT3, "Country"), id=("MC ID",), day=("Date",), number=n.ADS_MEASURES
)
ADS_SKU_DAILY = _struct(
    text=("SKU", "Currency", n.PT1, n.PT2, n.PT3, "Country", "customlabel1", "customlabel2", "customlabel4"),
    id=("MC ID",), day=("Date",), number=n.ADS_MEASURES,
)
ADS_CAMPAIGN_DAILY = _struct(
    text=("Campaign", "SKU", "currency", n.PT3, "Country"), id=("Campaign ID", "MC ID"),
    day=("Date",), number=n.CAMPAIGN_ADS_MEASURES,
)
ADS_MONTHLY = _struct(
    text=("SKU", "Currency", n.PT3, "Country"), id=("MC ID",), day=("Month",), number=n.ADS_MEASURES
)
SENSOR_DAILY = _struct(text=("SKU",), day=("Date",), number=n.SENSOR_MEASURES)
SENSOR_CAMPAIGN_DAILY = _struct(
    text=("SKU", "Campaign"), id=("Campaign ID",), day=("Date",), number=n.CAMPAIGN_SENSOR_MEASURES
)
SENSOR_MONTHLY = _struct(text=("SKU",), day=("Month",), number=n.SENSOR_MEASURES)
SPU_INDEX = _struct(text=("SKU", "SPU"))
PRODUCT_LABEL = _struct(text=("SKU", "customlabel1", "imagelink"), number=(n.PRICE,))
SPU_REGISTER = _struct(text=("SPU", n.IMAGE))
