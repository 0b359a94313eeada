"""Threshold bands of the reports as plain text columns ('none' = no band)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spendscope import names as n


def cost_band(cost: Column) -> Column:
    return (
        F.when(cost.isNull() | F.isnan(cost) | (cost == 0), "none")
        .when((cost > 0) & (cost < n.COST_LOW), "low")
        .when((cost >= n.COST_LOW) & (cost < n.COST_MID), "mid")
        .otherwise("high")
    )


def roi_band(roi: Column) -> Column:
    return F.when(roi < n.ROI_WEAK, "weak").when(roi > n.ROI_STRONG, "strong").otherwise("none")


def change_direction(change: Column) -> Column:
    """Direction of a relative change as displayed, in hundredths of a percent."""
    shown = F.round(change * 100, 2)
    return F.when(shown <= 0, "down").when(shown > 0, "up").otherwise("none")


def generation_flag(generation: Column) -> Column:
    return F.when(generation == n.NEW_LISTING, "new").when(generation == n.OLD_LISTING, "old").otherwise("other")
