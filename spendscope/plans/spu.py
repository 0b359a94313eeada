"""Reports of the product-family (SPU) pages, daily and monthly.

Inputs are the raw tables: ads rows, sensor rows, the SPU index and the product
labels. Date ranges and SPU choices cut the facts before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from spendscope import names as n
from spendscope.functions.dates import monthly_to_daily, range_divisor, within
from spendscope.functions.ratios import raw_ratio, relative_change
from spendscope.operators import rollup
from spendscope.operators.cleaning import DAILY, MONTHLY, clean_ads
from spendscope.operators.enrich import enrich, fold_enriched, normalise_index, only_skus_of
from spendscope.operators.day_vectors import day_vectors
from spendscope.operators.matrix import day_matrix, with_bands
from spendscope.operators.range_sums import RunningTotals, range_sums, running_totals
from spendscope.sources.keys import Keys, restrict
from spendscope.sources.tables import drop_missing

ALL_MEASURES = (*n.ADS_MEASURES, *n.SENSOR_MEASURES)
Day = date | str


def enriched_rows(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, monthly: bool = False, only: DataFrame | None = None
) -> DataFrame:
    """Every row of ads joined with products and sensor facts; ``only`` names the SKUs wanted."""
    shape, period = (MONTHLY, "Month") if monthly else (DAILY, "Date")
    sensor, index = drop_missing(sensor, "SKU"), normalise_index(spu)
    if only is not None:
        sensor, index, label = (df.join(only, "SKU", "left_semi") for df in (sensor, index, label))
    return enrich(clean_ads(ads, shape, only=only), label, sensor, index, period)


def folded_rows(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    label: DataFrame,
    *,
    monthly: bool = False,
    dates: tuple[Day, Day] | None = None,
    spus: Keys | None = None,
    generation: bool = False,
    attributes: Sequence[str] = (),
) -> DataFrame:
    """Folded enriched rows, the common input of the sums below."""
    shape, period = (MONTHLY, "Month") if monthly else (DAILY, "Date")
    index = normalise_index(spu)
    sensor = drop_missing(sensor, "SKU")
    if dates:
        ads = ads.where(within(F.col(period), *dates))
        sensor = sensor.where(within(F.col(period), *dates))
    chosen = None
    if spus is not None:
        chosen = only_skus_of(index, spus)
        # the products of the chosen SKUs, all their SPUs included, suffice
        sensor, index, label = (df.join(chosen, "SKU", "left_semi") for df in (sensor, index, label))
    merged = clean_ads(ads, shape, only=chosen)
    # a SKU has as many rows as days and categories at most before it meets products
    sums = [rollup.total(m).alias(m) for m in n.ADS_MEASURES]
    summed = merged.groupBy("SKU", period, n.PT3).agg(*sums, F.count("*").cast("double").alias("ads_rows"))
    return fold_enriched(
        summed, label, sensor, index,
        keys=("SKU", period), generation=generation, attributes=attributes, spus=spus, ads_count="ads_rows",
    )


def _report(sums: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), scale: float = 100.0) -> DataFrame:
    shown = rollup.relabel(rollup.with_ratios(sums, scale), n.REPORT_LABELS)
    return shown.select(*[f"`{c}`" for c in (*keys, *columns)])


def month_history(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys
) -> DataFrame:
    """Daily means per month of the chosen SPUs. ``ads`` and ``sensor`` are monthly.

    The days of a month divide its sum once, not each of its rows.
    """
    rows = folded_rows(ads, sensor, spu, label, monthly=True, spus=spus)
    sums = rollup.group_sum(rows, ["Month"], ALL_MEASURES)
    means = sums.withColumns({m: monthly_to_daily(F.col(m), F.col("Month")) for m in ALL_MEASURES})
    shown = rollup.relabel(rollup.with_ratios(means, 100.0), n.DAILY_MEAN_LABELS)
    return shown.select("Month", *[f"`{c}`" for c in n.MONTH_REPORT])


def day_detail(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys
) -> DataFrame:
    """Sums and ratios per day of the chosen SPUs."""
    rows = folded_rows(ads, sensor, spu, label, spus=spus)
    return _report(rollup.group_sum(rows, ["Date"], ALL_MEASURES), n.DAY_REPORT, ["Date"])


def range_total(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys, first: Day, last: Day
) -> DataFrame:
    """One row of sums over a date range of the chosen SPUs."""
    rows = folded_rows(ads, sensor, spu, label, dates=(first, last), spus=spus)
    return _report(rollup.grand_total(rows, ALL_MEASURES), n.DAY_REPORT, scale=1.0)


def range_mean(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys, first: Day, last: Day
) -> DataFrame:
    """Daily means over a date range; the divisor is last minus first."""
    rows = folded_rows(ads, sensor, spu, label, dates=(first, last), spus=spus)
    days = range_divisor(first, last)
    sums = rollup.grand_total(rows, ALL_MEASURES)
    means = sums.withColumns({m: raw_ratio(F.col(m), days) for m in ALL_MEASURES})
    return _report(means, n.DAY_REPORT, scale=1.0)


def spu_trend(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    label: DataFrame,
    first: Day,
    last: Day,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Sums and ratios per SPU and category over a date range."""
    rows = folded_rows(ads, sensor, spu, label, dates=(first, last))
    keys = ["SPU", n.PT3]
    trend = _report(rollup.group_sum(rows, keys, ALL_MEASURES), n.DAY_REPORT, keys)
    return restrict(trend, n.PT3, categories) if categories else trend


def spu_skus(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys, first: Day, last: Day
) -> DataFrame:
    """SKUs of the chosen SPUs over a date range."""
    rows = folded_rows(ads, sensor, spu, label, dates=(first, last), spus=spus, generation=True)
    keys = ["SKU", "SPU", n.PT3, n.GENERATION]
    return _report(rollup.group_sum(rows, keys, ALL_MEASURES), n.DAY_REPORT, keys)


MATRIX_ROWS = ("SPU", "SKU", n.GENERATION)


def spu_cost_matrix(
    ads: DataFrame,
    sensor: DataFrame,
    spu: DataFrame,
    label: DataFrame,
    spus: Keys,
    first: Day | None = None,
    last: Day | None = None,
    bands: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Daily cost per SKU of the chosen SPUs, with cost bands.

    Without ``first`` and ``last`` the matrix spans all days of the ads table,
    which takes one small job beforehand, as columns must be known to the plan.
    ``strict`` looks at the full joined rows, where a repeated product row or a
    repeated ads row makes a cell ambiguous.
    """
    if first is None or last is None:
        low, high = rollup.extremes(ads, "Date").first()
        first, last = first or low, last or high
        if first is None:
            first = last = date.today()  # no ads row at all: one empty day
    if strict:
        chosen = only_skus_of(normalise_index(spu), spus)
        rows = restrict(enriched_rows(ads, sensor, spu, label, only=chosen), "SPU", spus)
    else:
        rows = folded_rows(ads, sensor, spu, label, dates=(first, last), spus=spus, generation=True)
    matrix = day_matrix(rows, MATRIX_ROWS, first, last, strict=strict)
    return with_bands(matrix, MATRIX_ROWS) if bands else matrix


def spu_cost_vectors(
    ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys, dates: tuple[Day, Day] | None = None
) -> DataFrame:
    """Daily cost per SKU of the chosen SPUs as sparse day vectors, over a range or over all days.

    The form for long ranges: the plan is the same for any number of days, and no job
    is run to learn them.
    """
    rows = folded_rows(ads, sensor, spu, label, dates=dates, spus=spus, generation=True)
    return day_vectors(rows, MATRIX_ROWS)


def spu_running_totals(ads: DataFrame, sensor: DataFrame, spu: DataFrame, label: DataFrame, spus: Keys | None = None) -> RunningTotals:
    """Running totals of all measures per SPU and day, to be stored and asked for many ranges."""
    return running_totals(folded_rows(ads, sensor, spu, label, spus=spus), ["SPU"], ALL_MEASURES)


def totals_of_ranges(totals: RunningTotals, ranges: DataFrame, by: Sequence[str] = ("first", "last")) -> DataFrame:
    """The report of ``range_total`` for every row of a table of ranges (SPU, first, last)."""
    return _report(range_sums(totals, ranges, by), n.DAY_REPORT, by, scale=1.0)


def means_of_ranges(totals: RunningTotals, ranges: DataFrame) -> DataFrame:
    """The report of ``range_mean`` for every range; the divisor is last minus first."""
    sums = range_sums(totals, ranges)
    days = F.datediff("last", "first").cast("double")
    means = sums.withColumns({m: raw_ratio(F.col(f"`{m}`"), days) for m in ALL_MEASURES})
    return _report(means, n.DAY_REPORT, ["first", "last"], scale=1.0)


def changes_of_ranges(totals: RunningTotals, ranges: DataFrame, measures: Sequence[str] = ALL_MEASURES) -> DataFrame:
    """Relative change of each measure from a range to the range of the same length right after it, for many ranges at once.

    Both ranges of a pair are looked up in the same join.
    """
    length = F.datediff("last", "first") + 1
    begin = {"base_first": F.col("first"), "base_last": F.col("last")}
    base = ranges.withColumns(begin | {"period": F.lit("base")})
    after = ranges.withColumns(begin | {"period": F.lit("after")}).withColumns(
        {"first": F.date_add("base_last", 1), "last": F.date_add("base_last", length)})
    sums = range_sums(totals, base.unionByName(after), ("base_first", "base_last", "period"))
    pick = lambda m, p: F.max(F.when(F.col("period") == p, F.col(f"`{m}`")))
    both = sums.groupBy(F.col("base_first").alias("first"), F.col("base_last").alias("last")).agg(
        *[pick(m, p).alias(f"{m} {p}") for m in measures for p in ("base", "after")])
    return both.select("first", "last", *[relative_change(F.col(f"`{m} base`"), F.col(f"`{m} after`")).alias(m) for m in measures])
