"""String rules for SKU identifiers and listing labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spendscope import names as n

_EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def normalise_sku(sku: Column) -> Column:
    """Trim every kind of blank at both ends, delete line feeds, upper-case.

    Tabs inside the value stay, as the reports expect.
    """
    trimmed = F.regexp_replace(sku, _EDGE_BLANKS, "")
    return F.upper(F.replace(trimmed, F.lit("\n"), F.lit("")))


def cut_suffix(text: Column, length: int = n.SUFFIX_LENGTH) -> Column:
    """Text without its last ``length`` characters ('' when shorter)."""
    return F.left(text, F.length(text) - length)


def merchant_sku(sku: Column, merchant: Column) -> Column:
    """SKU without the tail that the suffixed merchant appends."""
    return F.when(merchant == n.SUFFIXED_MERCHANT, cut_suffix(sku)).otherwise(sku)


def main_merchant(merchant: Column) -> Column:
    """Merchant id with the suffixed merchant folded into the main one."""
    return F.when(merchant == n.SUFFIXED_MERCHANT, F.lit(n.MAIN_MERCHANT).cast("long")).otherwise(merchant)


def without_home_suffix(sku: Column) -> Column:
    """SKU without a trailing ``-hm`` (case-sensitive)."""
    return F.when(F.endswith(sku, F.lit(n.HOME_SUFFIX)), cut_suffix(sku)).otherwise(sku)


def listing_generation(label: Column) -> Column:
    """New, old (also for a missing label) or the label itself."""
    return (
        F.when(F.contains(label, F.lit(n.NEW_MARK)), n.NEW_LISTING)
        .when(label.isNull() | F.contains(label, F.lit(n.OLD_MARK)), n.OLD_LISTING)
        .otherwise(label)
    )
