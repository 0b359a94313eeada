"""Totals of two periods and the change between them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.bands import change_direction
from spendscope.functions.dates import range_label, within
from spendscope.functions.present import STYLES, percent
from spendscope.functions.ratios import raw_ratio, relative_change
from spendscope.operators.rollup import total

BASE, COMPARE, CHANGE = "base", "compare", "change"
Range = tuple[date | str, date | str]
METRICS = (*n.PERIOD_MEASURES, *n.PERIOD_RATIOS)


def tag_periods(df: DataFrame, periods: Mapping[str, Range], on: str = "Date") -> DataFrame:
    """Rows of any period with its name; a row in two periods comes twice.

    One pass over the facts serves all periods.
    """
    inside = {name: within(F.col(on), *bounds) for name, bounds in periods.items()}
    kept = df.where(reduce(or_, inside.values()))
    if len(inside) == 1:
        return kept.withColumn("period", F.lit(next(iter(inside))))
    marks = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in inside.items()]))
    return kept.withColumn("period", F.explode(marks))


def _total_ratios(value: Mapping[str, Column]) -> dict[str, Column]:
    return {
        n.CONVERSION: raw_ratio(value["支付用户数"], value["UV"]),
        n.ADD_TO_CART: raw_ratio(value["加购"], value["UV"]),
        n.TOTAL_CTR: raw_ratio(value["点击"], value["展示"]),
        n.ADS_ROI: raw_ratio(value["ads value"], value["费用"]),
        n.TOTAL_SENSOR_ROI: raw_ratio(value["GMV"], value["费用"]),
        n.CPC: raw_ratio(value["费用"], value["点击"]),
    }


def period_totals(rows: DataFrame, periods: Mapping[str, Range]) -> DataFrame:
    """One row per period (``row_kind``), also for a period without rows.

    All periods are added up in one global aggregate and then laid out as rows.
    """
    sums = rows.agg(*[
        total(F.when(F.col("period") == name, F.col(f"`{m}`"))).alias(f"{name}:{m}")
        for name in periods for m in n.PERIOD_MEASURES
    ])
    lines = []
    for name, bounds in periods.items():
        value = {m: F.col(f"`{name}:{m}`") for m in n.PERIOD_MEASURES}
        value |= _total_ratios(value)
        lines.append(F.struct(
            F.lit(name).alias("row_kind"),
            F.lit(range_label(*bounds)).alias(n.DATE_RANGE),
            *[value[m].alias(m) for m in METRICS],
        ))
    return sums.select(F.inline(F.array(*lines)))


def _side_by_side(totals: DataFrame) -> DataFrame:
    """The two period rows as two struct columns of one row."""
    line = F.struct("row_kind", *[f"`{c}`" for c in (n.DATE_RANGE, *METRICS)])
    return totals.agg(*[
        F.first(F.when(F.col("row_kind") == kind, line), ignorenulls=True).alias(kind)
        for kind in (BASE, COMPARE)
    ])


def _change(metric: str) -> Column:
    return relative_change(F.col(BASE).getField(metric), F.col(COMPARE).getField(metric))


def _line(kind: str, label: Column, cells: Mapping[str, Column]) -> Column:
    return F.struct(
        F.lit(kind).alias("row_kind"),
        label.alias(n.DATE_RANGE),
        *[cell.alias(metric) for metric, cell in cells.items()],
    )


def with_change_row(totals: DataFrame) -> DataFrame:
    """The base and compare rows plus a row of relative changes."""
    change = _line(CHANGE, F.lit(n.CHANGE_ROW), {m: _change(m) for m in METRICS})
    return _side_by_side(totals).select(F.inline(F.array(F.col(BASE), F.col(COMPARE), change)))


def comparison_text(totals: DataFrame) -> DataFrame:
    """Report text: period rows by their column layout, changes as percents.

    A change from 0 is an empty text, a change of an undefined value 'nan%'.
    """
    lines = []
    for kind in (BASE, COMPARE):
        value = F.col(kind).getField
        lines.append(_line(kind, value(n.DATE_RANGE), {
            m: STYLES[n.TOTAL_TEXT[m]](value(m)) for m in METRICS
        }))
    lines.append(_line(CHANGE, F.lit(n.CHANGE_ROW), {
        m: F.when(F.col(BASE).getField(m) == 0, "").otherwise(F.coalesce(percent(_change(m)), F.lit("nan%")))
        for m in METRICS
    }))
    return _side_by_side(totals).select(F.inline(F.array(*lines)))


def change_directions(comparison: DataFrame) -> DataFrame:
    """Direction of every metric of the change row, as ``<metric> direction``."""
    changed = comparison.where(F.col("row_kind") == CHANGE)
    return changed.select(*[change_direction(F.col(f"`{m}`")).alias(f"{m} direction") for m in METRICS])
