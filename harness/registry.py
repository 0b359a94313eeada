"""Registered queries: one per inventory entry, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from harness import choices as ch, mapping as m
from spendscope import names as n
from spendscope.functions import bands, conditions, dates, ratios, text
from spendscope.functions.present import as_text
from spendscope.operators import cleaning, compare, day_vectors, enrich, matrix, range_sums, rollup, series
from spendscope.plans import campaign, pruning, register, sku, spu, yearly
from spendscope.session import share_out
from spendscope.sources import checked, keys, state, statistics, tables
from spendscope.sources.scratch import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
REPORTS: dict[str, Query] = {}  # as a user gets them
QUERIES: dict[str, Query] = {}  # made comparable with SQL
c = F.col


def comparable(df: DataFrame) -> DataFrame:
    """Plain values for comparison with SQL: four decimals, ISO dates, joined lists.

    The tiny shift keeps exact rounding ties from hanging on the order in which
    doubles were added.
    """

    def plain(field: T.StructField) -> Column:
        column = c(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column + 1e-9, 4)
        elif isinstance(field.dataType, T.DateType):
            column = dates.iso(column)
        elif isinstance(field.dataType, T.ArrayType):
            if isinstance(field.dataType.elementType, T.DoubleType):
                column = F.transform(column, lambda x: F.format_string("%.4f", x + 1e-9))
            column = F.array_join(column, ",")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


def query(name: str) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        REPORTS[name] = build
        QUERIES[name] = lambda spark, sf_dir: comparable(build(share_out(spark, f"{sf_dir}/lineitem.parquet"), sf_dir))
        return build

    return add


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """How many rows carry each combination of values."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def shown_as_text(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    """Report text of the comparable numbers: sums that end on a rounding tie
    would otherwise print one way or the other with the order of addition."""
    return as_text(comparable(df), layout)


def spu_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return m.ads_daily(spark, d), m.sensor_daily(spark, d), m.spu_index(spark, d), m.product_label(spark, d)


def month_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return m.ads_monthly(spark, d), m.sensor_monthly(spark, d), m.spu_index(spark, d), m.product_label(spark, d)


def sku_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return m.ads_sku_daily(spark, d), m.sensor_campaign_daily(spark, d), m.spu_index(spark, d)


def campaign_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return (m.ads_campaign_daily(spark, d), m.sensor_campaign_daily(spark, d), m.spu_index(spark, d),
            m.product_label(spark, d))


def chosen_spus(s: SparkSession, d: str) -> DataFrame:
    """The chosen SPUs as a key table."""
    return m.spu_index(s, d).where(c("SPU").isin(*ch.SPUS)).select(c("SPU").alias("key")).distinct()


def chosen_campaigns(s: SparkSession, d: str) -> DataFrame:
    return m.ads_campaign_daily(s, d).where(c("Campaign").isin(*ch.CAMPAIGNS)).select(c("Campaign").alias("key")).distinct()


# -- scans and headers --------------------------------------------------------

query("a1_ads_daily")(lambda s, d: tables.conform(m.ads_sku_daily(s, d), tables.ADS_SKU_DAILY))
query("a1_ads_campaign_daily")(lambda s, d: m.ads_campaign_daily(s, d))
query("a2_ads_monthly")(lambda s, d: tables.conform(m.ads_monthly(s, d), tables.ADS_MONTHLY))
query("a3_sensor_daily")(lambda s, d: tables.conform(m.sensor_daily(s, d), tables.SENSOR_DAILY))
query("a3_sensor_campaign_daily")(lambda s, d: m.sensor_campaign_daily(s, d))
query("a4_sensor_monthly")(lambda s, d: tables.conform(m.sensor_monthly(s, d), tables.SENSOR_MONTHLY))
query("a5_spu_index")(lambda s, d: tables.conform(m.spu_index(s, d), tables.SPU_INDEX))
query("a6_product_label")(lambda s, d: tables.conform(m.product_label(s, d), tables.PRODUCT_LABEL))


@query("a9_canonical_headers")
def _(s: SparkSession, d: str) -> DataFrame:
    sheet = m.sensor_monthly(s, d).withColumnsRenamed({v: k for k, v in n.SENSOR_MONTHLY_HEADERS.items()})
    return tables.canonical(sheet, n.SENSOR_MONTHLY_HEADERS)




@query("a8_written_and_read")
def _(s: SparkSession, d: str) -> DataFrame:
    """Ads rows written by month under sheet headers and read back."""
    path = shared_folder(s, "sensor-export")
    sheet = m.sensor_monthly(s, d).withColumnsRenamed({v: k for k, v in n.SENSOR_MONTHLY_HEADERS.items()})
    tables.write_result(sheet.withColumn("year", F.year("月")), path, partition_by=["year"])
    return tables.read_table(s, tables.SENSOR_MONTHLY, path)


def _broken_export(s: SparkSession, d: str) -> str:
    """Ads rows as a CSV sheet in which some cells are spoilt: dates, costs, merchant ids, and some SKUs are blank."""
    path, text = shared_folder(s, "broken-export"), lambda x: c(f"`{x}`").cast("string")
    sheet = m.ads_daily(s, d).select(
        F.when(c("impression") == 4900, "").otherwise(c("SKU")).alias("SKU"), "Currency", f"`{n.PT3}`", "Country",
        F.when(c("click") == 13, "n/a").otherwise(text("MC ID")).alias("MC ID"),
        F.when(F.dayofmonth("Date") == 31, F.date_format("Date", "dd.MM.yyyy")).otherwise(dates.iso(c("Date"))).alias("Date"),
        text("impression").alias("impression"), F.when(c("cost") == 0, " ").when(c("cost") % 97 == 5, "12,5").otherwise(text("cost")).alias("cost"),
        text("click").alias("click"), text("conversions").alias("conversions"), text("ads value").alias("ads value"))
    tables.write_result(sheet, path, "csv")
    return path


def _checked(s: SparkSession, d: str) -> checked.Checked:
    return checked.read_checked(s, tables.ADS_DAILY, _broken_export(s, d), "csv", line_feeds=True, required=("SKU",))


query("a1_checked_rows")(lambda s, d: _checked(s, d).good)
query("a1_rejects")(lambda s, d: counted(_checked(s, d).rejects.withColumns({x: c("raw")[x] for x in ("Date", "cost", "MC ID")}), "reason", "Date", "cost", "MC ID"))
query("a1_reject_counts")(lambda s, d: checked.reject_counts(_checked(s, d)))

# -- filters and projections --------------------------------------------------

query("b1_labelled_rows")(
    lambda s, d: counted(tables.drop_missing(m.ads_sku_daily(s, d), "customlabel1"), "SKU", "customlabel1")
)


@query("b2_dense_rows")
def _(s: SparkSession, d: str) -> DataFrame:
    ads = m.ads_sku_daily(s, d)
    filled = [f for f in ads.columns if f not in ("Country", "customlabel1", "customlabel4")]
    return counted(tables.drop_sparse_rows(ads, present=filled), "SKU", "Country", "customlabel1", "customlabel4")


query("b3_date_range")(lambda s, d: m.sensor_daily(s, d).where(dates.within(c("Date"), *ch.BASE)))
query("b4_month_range")(lambda s, d: m.sensor_monthly(s, d).where(dates.within(c("Month"), *ch.YEAR)))
query("b5_chosen_members")(lambda s, d: keys.restrict(m.spu_index(s, d), "SPU", ch.SPUS))
query("b6_key_lines")(
    lambda s, d: keys.restrict(m.spu_index(s, d), "SPU", keys.keys_from_text(s, "\n".join(ch.SPUS), "SPU"))
)


def _campaign_filter(test: Callable[[Column], Column]) -> Query:
    return lambda s, d: counted(m.sensor_campaign_daily(s, d).where(test(c("Campaign"))), "Campaign", "Campaign ID")


query("b7_all_patterns")(_campaign_filter(lambda x: conditions.matches_all(x, ["high|low", "BUILD"])))
query("b8_any_pattern")(_campaign_filter(lambda x: conditions.matches_any(x, ["^1-", "furn"])))
query("b9_no_pattern")(_campaign_filter(lambda x: conditions.matches_none(x, ["specified", "auto"])))
query("b10_condition")(_campaign_filter(ch.CONDITION.on))
query("b11_chosen_columns")(lambda s, d: m.product_label(s, d).select("SKU", n.PRICE))
query("b12_without_columns")(lambda s, d: m.product_label(s, d).drop("imagelink", "customlabel1"))
query("b13_column_first")(lambda s, d: rollup.to_front(m.product_label(s, d), n.PRICE))
query("b14_report_labels")(
    lambda s, d: rollup.relabel(rollup.grand_total(m.ads_daily(s, d), n.ADS_MEASURES), n.REPORT_LABELS)
)

# -- row rules ----------------------------------------------------------------

query("c1_merchant_suffix")(
    lambda s, d: counted(cleaning.strip_merchant_suffix(m.ads_daily(s, d)), "SKU", "MC ID")
)
query("c2_merchant_remap")(lambda s, d: counted(cleaning.remap_merchant(m.ads_daily(s, d)), "SKU", "MC ID"))
query("c3_home_suffix")(lambda s, d: counted(cleaning.strip_home_suffix(m.ads_daily(s, d)), "SKU"))
query("c4_report_currency")(
    lambda s, d: cleaning.to_report_currency(m.ads_daily(s, d)).select("SKU", "Currency", "cost", "`ads value`")
)
query("c5_normalised_sku")(lambda s, d: counted(cleaning.normalise_sku(m.ads_daily(s, d)), "SKU"))
query("c6_generation")(
    lambda s, d: cleaning.label_generation(m.product_label(s, d)).select("SKU", n.GENERATION)
)


@query("c7_filled_rows")
def _(s: SparkSession, d: str) -> DataFrame:
    ads, _, index, label = campaign_tables(s, d)
    rows = enrich.attach_spu(cleaning.clean_ads(ads, cleaning.CAMPAIGN), enrich.normalise_index(index))
    rows = enrich.attach_label(rows, label, (n.PRICE, "imagelink"))
    return counted(enrich.fill_missing(rows), "SKU", "SPU", n.GENERATION, n.PRICE, "imagelink")


query("c8_parsed_dates")(
    lambda s, d: counted(m.ads_daily(s, d).withColumn("Date", F.to_date(dates.iso(c("Date")))), "Date")
)
query("c9_date_text")(
    lambda s, d: counted(
        m.ads_daily(s, d).select(
            dates.iso(c("Date")).alias("day"), F.lit(dates.range_label(*ch.BASE)).alias(n.DATE_RANGE)
        ),
        "day", n.DATE_RANGE,
    )
)

# -- joins --------------------------------------------------------------------


@query("d1_ads_with_spu")
def _(s: SparkSession, d: str) -> DataFrame:
    ads = cleaning.clean_ads(m.ads_daily(s, d), cleaning.DAILY)
    return enrich.attach_spu(ads, enrich.normalise_index(m.spu_index(s, d)))


@query("d2_ads_with_label")
def _(s: SparkSession, d: str) -> DataFrame:
    ads = cleaning.clean_ads(m.ads_daily(s, d), cleaning.DAILY)
    return enrich.attach_label(ads, m.product_label(s, d))


query("d3_sensor_by_products")(
    lambda s, d: enrich.repeat_by_products(
        m.sensor_daily(s, d), enrich.normalise_index(m.spu_index(s, d)), m.product_label(s, d)
    )
)
query("q2_enriched_daily")(lambda s, d: spu.enriched_rows(*spu_tables(s, d)))
query("q3_enriched_monthly")(lambda s, d: spu.enriched_rows(*month_tables(s, d), monthly=True))
query("q4_enriched_campaign")(lambda s, d: campaign.enriched_rows(*campaign_tables(s, d)))

# -- aggregates over whole tables --------------------------------------------

query("q1_clean_ads")(lambda s, d: cleaning.clean_ads(m.ads_daily(s, d), cleaning.DAILY))
query("e1_daily_merge")(
    lambda s, d: cleaning.merge_repeats(cleaning.repair_rows(m.ads_daily(s, d), cleaning.DAILY), cleaning.DAILY)
)


@query("e1_refreshed_by_deliveries")
def _(s: SparkSession, d: str) -> DataFrame:
    """The daily merge from three deliveries: half of the rows, with some of them wrong; the wrong ones corrected and most of the rest; late rows."""
    ads, path = m.ads_daily(s, d), shared_folder(s, "ads-state")
    early, late = c("click") < 25, F.dayofmonth("Date") == 7
    wrong = early & (c("conversions") == 3)
    spoilt = ads.withColumns({"cost": c("cost") + 1, "Country": F.when(c("impression") == 700, "nowhere").otherwise(c("Country"))})
    first = state.delivery(ads.where(early & ~wrong & ~late).unionByName(spoilt.where(wrong & ~late)))
    second = state.delivery(ads.where(~early & ~late).unionByName(ads.where(wrong & ~late)), spoilt.where(wrong & ~late))
    for number, rows in enumerate((first, second, state.delivery(ads.where(late)), second), 1):
        state.refresh(s, path, rows, cleaning.DAILY, min(number, 3))  # the last one is a repetition and changes nothing
    return state.current(s, path, cleaning.DAILY)


query("e2_sku_daily_merge")(lambda s, d: cleaning.clean_ads(m.ads_sku_daily(s, d), cleaning.SKU_DAILY))
query("e3_campaign_merge")(lambda s, d: cleaning.clean_ads(m.ads_campaign_daily(s, d), cleaning.CAMPAIGN))
query("e4_monthly_merge")(lambda s, d: cleaning.clean_ads(m.ads_monthly(s, d), cleaning.MONTHLY))


@query("e5_sensor_summary")
def _(s: SparkSession, d: str) -> DataFrame:
    _, sensor, index = sku_tables(s, d)
    return sku.sensor_summary(sensor, index, {compare.BASE: YEAR_DAYS}).drop("period", "copies")


YEAR_DAYS = ("2023-01-01", "2023-12-31")


@query("e7_period_total")
def _(s: SparkSession, d: str) -> DataFrame:
    periods = {compare.BASE: YEAR_DAYS}
    return compare.period_totals(sku.period_rows(*sku_tables(s, d), periods), periods)


@query("e8_month_rollup")
def _(s: SparkSession, d: str) -> DataFrame:
    return rollup.group_sum(spu.folded_rows(*month_tables(s, d), monthly=True), ["Month"], spu.ALL_MEASURES)


def _daily_rollup(*group: str, **options: object) -> Query:
    return lambda s, d: rollup.group_sum(spu.folded_rows(*spu_tables(s, d), **options), group, spu.ALL_MEASURES)


query("e9_day_rollup")(_daily_rollup("Date"))
query("e10_spu_rollup")(_daily_rollup("SPU", n.PT3))
query("e11_sku_rollup")(_daily_rollup("SKU", "SPU", n.PT3, n.GENERATION, generation=True))


@query("e12_price_rollup")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = spu.folded_rows(*month_tables(s, d), monthly=True, generation=True, attributes=(n.PRICE,))
    return rollup.group_sum(rows, yearly.SUMMARY_KEYS, spu.ALL_MEASURES)


query("e13_campaign_points")(
    lambda s, d: campaign.campaign_points(*campaign_tables(s, d), *YEAR_DAYS)
)
query("e15_product_totals")(
    lambda s, d: series.product_totals(campaign.folded_rows(*campaign_tables(s, d), *YEAR_DAYS))
)


@query("e16_first_rows")
def _(s: SparkSession, d: str) -> DataFrame:
    # the rows of a label key are alike in the remaining columns
    labels = m.ads_sku_daily(s, d).select("SKU", "customlabel1", "customlabel2", n.PT1, n.PT3)
    return rollup.first_rows(labels, ["SKU", "customlabel1", "customlabel2"])


@query("e17_range_total")
def _(s: SparkSession, d: str) -> DataFrame:
    return rollup.grand_total(spu.folded_rows(*spu_tables(s, d), dates=YEAR_DAYS), spu.ALL_MEASURES)


@query("e18_range_mean")
def _(s: SparkSession, d: str) -> DataFrame:
    sums = rollup.grand_total(spu.folded_rows(*spu_tables(s, d), dates=YEAR_DAYS), spu.ALL_MEASURES)
    days = dates.range_divisor(*YEAR_DAYS)
    return sums.select(*[ratios.raw_ratio(c(f"`{x}`"), days).alias(x) for x in spu.ALL_MEASURES])


query("e19_date_extremes")(lambda s, d: rollup.extremes(m.ads_daily(s, d), "Date"))


@query("e19_stored_extremes")
def _(s: SparkSession, d: str) -> DataFrame:
    """First and last day of stored ads rows, from the files' footers."""
    path = shared_folder(s, "ads-facts")
    tables.write_result(m.ads_daily(s, d), path)
    return statistics.footer_bounds(s, path, "Date", "cost")


query("e20_report_maxima")(
    lambda s, d: rollup.column_maxima(spu.spu_trend(*spu_tables(s, d), *ch.BASE), n.DAY_REPORT)
)
query("e20_column_maxima")(lambda s, d: rollup.column_maxima(m.sensor_daily(s, d), n.SENSOR_MEASURES))
query("e21_distinct_campaigns")(lambda s, d: rollup.distinct_values(m.ads_campaign_daily(s, d), "Campaign"))

# -- ratios -------------------------------------------------------------------


def _ratio(column: str, scale: float) -> Query:
    def build(s: SparkSession, d: str) -> DataFrame:
        sums = _daily_rollup("SKU", "Date")(s, d)
        return rollup.with_ratios(sums, scale).select("SKU", "Date", f"`{column}`")

    return build


query("f1_sensor_roi")(_ratio(n.SENSOR_ROI, 1.0))
query("f2_ads_roi")(_ratio(n.ADS_ROI, 1.0))
query("f3_cpc")(_ratio(n.CPC, 1.0))
query("f4_ctr")(_ratio(n.CTR, 100.0))
query("f5_conversion")(_ratio(n.CONVERSION, 100.0))
query("f6_add_to_cart")(_ratio(n.ADD_TO_CART, 1.0))
query("f8_daily_means")(
    lambda s, d: m.sensor_monthly(s, d).select(
        "SKU", "Month", *[dates.monthly_to_daily(c(x), c("Month")).alias(x) for x in n.SENSOR_MEASURES]
    )
)

# -- reports ------------------------------------------------------------------

query("q5_month_history")(lambda s, d: spu.month_history(*month_tables(s, d), ch.SPUS))
query("q6_day_detail")(lambda s, d: spu.day_detail(*spu_tables(s, d), ch.SPUS))
query("q7_range_mean")(lambda s, d: spu.range_mean(*spu_tables(s, d), ch.SPUS, *ch.BASE))
query("q8_range_total")(lambda s, d: spu.range_total(*spu_tables(s, d), ch.SPUS, *ch.BASE))
query("q8_range_total_text")(
    lambda s, d: shown_as_text(spu.range_total(*spu_tables(s, d), ch.SPUS, *ch.BASE), n.RANGE_TEXT)
)


def _weeks(s: SparkSession, d: str) -> DataFrame:
    """Every week that begins on a day of the ads table, for each chosen SPU."""
    return range_sums.sliding_ranges(m.ads_daily(s, d), 7).crossJoin(chosen_spus(s, d).withColumnRenamed("key", "SPU"))


query("e17_many_ranges")(
    lambda s, d: range_sums.range_sums(
        range_sums.running_totals(spu.folded_rows(*spu_tables(s, d)), [], spu.ALL_MEASURES), range_sums.sliding_ranges(m.ads_daily(s, d), 30))
)
query("q7_many_ranges")(lambda s, d: spu.means_of_ranges(spu.spu_running_totals(*spu_tables(s, d), ch.SPUS), _weeks(s, d)))
query("q8_many_ranges")(lambda s, d: spu.totals_of_ranges(spu.spu_running_totals(*spu_tables(s, d), ch.SPUS), _weeks(s, d)))
query("q8_many_ranges_by_spu")(
    lambda s, d: spu.totals_of_ranges(spu.spu_running_totals(*spu_tables(s, d), ch.SPUS), _weeks(s, d), ("SPU", "first", "last"))
)
query("q14_many_ranges")(lambda s, d: spu.changes_of_ranges(spu.spu_running_totals(*spu_tables(s, d), ch.SPUS), _weeks(s, d)))
query("q9_spu_trend")(lambda s, d: spu.spu_trend(*spu_tables(s, d), *ch.BASE))
query("q9_spu_trend_of_categories")(
    lambda s, d: spu.spu_trend(*spu_tables(s, d), *ch.BASE, categories=ch.CATEGORIES)
)
query("q10_spu_skus")(lambda s, d: spu.spu_skus(*spu_tables(s, d), ch.SPUS, *ch.BASE))
query("q10_spu_skus_of_keys")(lambda s, d: spu.spu_skus(*spu_tables(s, d), chosen_spus(s, d), *ch.BASE))
query("q11_spu_cost_matrix")(lambda s, d: spu.spu_cost_matrix(*spu_tables(s, d), ch.SPUS, *ch.BASE))




@query("q11_spu_cost_matrix_all_days")
def _(s: SparkSession, d: str) -> DataFrame:
    """All days that an ads row can have: the matrix as a view over vectors of all rows, without a range."""
    vectors = spu.spu_cost_vectors(*spu_tables(s, d), ch.SPUS)
    first, last = m.CALENDAR
    return matrix.with_bands(day_vectors.day_columns(vectors, spu.MATRIX_ROWS, first, last), spu.MATRIX_ROWS)


query("q11_spu_cost_vectors")(
    lambda s, d: day_vectors.listed(spu.spu_cost_vectors(*spu_tables(s, d), ch.SPUS), spu.MATRIX_ROWS, bands=True)
)
query("q11_spu_cost_vectors_long")(
    lambda s, d: day_vectors.long_form(spu.spu_cost_vectors(*spu_tables(s, d), chosen_spus(s, d), YEAR_DAYS), spu.MATRIX_ROWS)
)
query("q11_spu_cost_matrix_every_day")(lambda s, d: spu.spu_cost_matrix(*spu_tables(s, d), ch.SPUS))
query("q12_yearly_summary")(lambda s, d: yearly.yearly_summary(*month_tables(s, d)))
query("g2_summary_by_spu")(lambda s, d: yearly.by_spu(yearly.yearly_summary(*month_tables(s, d))))
query("q12_spu_lookup")(
    lambda s, d: yearly.spu_lookup(yearly.yearly_summary(*month_tables(s, d), spus=ch.SPUS), ch.SPUS)
)
query("q12_spu_lookup_text")(
    lambda s, d: shown_as_text(
        yearly.yearly_summary(*month_tables(s, d), spus=ch.SPUS).select("SPU", "SKU", *[f"`{x}`" for x in n.YEAR_TEXT]),
        n.YEAR_TEXT,
    )
)
query("g4_spu_category")(
    lambda s, d: yearly.spu_category(yearly.yearly_summary(*month_tables(s, d), spus=ch.SPUS), ch.SPUS)
)
query("q13_sku_period")(lambda s, d: sku.period_summary(*sku_tables(s, d), *ch.BASE))
query("q13_sku_period_condition")(
    lambda s, d: sku.period_summary(*sku_tables(s, d), *ch.BASE, condition=ch.CONDITION)
)
query("q13_sku_period_skus")(
    lambda s, d: sku.period_summary(*sku_tables(s, d), *ch.BASE, skus=ch.SKUS, condition=ch.CONDITION)
)
query("q13_sku_period_text")(
    lambda s, d: shown_as_text(sku.period_summary(*sku_tables(s, d), *ch.BASE), n.SKU_TEXT)
    .select("SKU", "SPU", n.PT1, n.PT2, n.PT3, n.GENERATION, *[f"`{x}`" for x in n.SKU_TEXT])
)
query("q13_sku_period_skus_only")(lambda s, d: sku.period_summary(*sku_tables(s, d), *ch.BASE, skus=ch.SKUS))
query("h1_two_periods")(lambda s, d: sku.compared_totals(*sku_tables(s, d), ch.BASE, ch.OTHER))
query("q14_compare_periods")(lambda s, d: sku.compare_periods(*sku_tables(s, d), ch.BASE, ch.OTHER))
query("q14_compare_condition")(
    lambda s, d: sku.compare_periods(*sku_tables(s, d), ch.BASE, ch.OTHER, condition=ch.CONDITION)
)
query("q14_compare_condition_both")(
    lambda s, d: sku.compare_periods(
        *sku_tables(s, d), ch.BASE, ch.OTHER, condition=ch.CONDITION, filter_compare=True
    )
)
query("q14_compare_skus")(
    lambda s, d: sku.compare_periods(
        *sku_tables(s, d), ch.BASE, ch.OTHER, skus=ch.SKUS, condition=ch.CONDITION
    )
)
query("q14_compare_skus_only")(
    lambda s, d: sku.compare_periods(*sku_tables(s, d), ch.BASE, ch.OTHER, skus=ch.SKUS)
)
query("j3_comparison_text")(
    lambda s, d: compare.comparison_text(sku.compared_totals(*sku_tables(s, d), ch.BASE, ch.OTHER))
)
query("k3_change_direction")(
    lambda s, d: compare.change_directions(sku.compare_periods(*sku_tables(s, d), ch.BASE, ch.OTHER))
)
query("g5_change_row")(
    lambda s, d: sku.compare_periods(*sku_tables(s, d), ch.BASE, ch.OTHER).where(c("row_kind") == compare.CHANGE)
)


@query("q15_sku_cost_matrix")
def _(s: SparkSession, d: str) -> DataFrame:
    ads, _, index = sku_tables(s, d)
    return sku.sku_cost_matrix(ads, index, ch.SKUS, *ch.BASE)


@query("q15_sku_cost_vectors")
def _(s: SparkSession, d: str) -> DataFrame:
    ads, _, index = sku_tables(s, d)
    return day_vectors.listed(sku.sku_cost_vectors(ads, index, ch.SKUS), ["SKU"])


query("q16_campaign_series")(lambda s, d: campaign.campaign_series(*campaign_tables(s, d), *ch.BASE))
query("q16_campaign_series_chosen")(
    lambda s, d: campaign.campaign_series(*campaign_tables(s, d), *YEAR_DAYS, campaigns=ch.CAMPAIGNS)
)
query("q16_campaign_series_of_keys")(
    lambda s, d: campaign.campaign_series(*campaign_tables(s, d), *ch.BASE, campaigns=chosen_campaigns(s, d))
)
query("q16_campaign_days")(lambda s, d: campaign.campaign_day_series(*campaign_tables(s, d), *ch.BASE))
query("q16_campaign_days_chosen")(
    lambda s, d: campaign.campaign_day_series(*campaign_tables(s, d), *YEAR_DAYS, campaigns=ch.CAMPAIGNS)
)
query("q4_enriched_campaign_sorted")(lambda s, d: enrich.presented(campaign.enriched_rows(*campaign_tables(s, d))))
query("q17_campaigns_in_range")(lambda s, d: campaign.campaigns_in_range(m.ads_campaign_daily(s, d), *ch.BASE))


@query("q18_custom_labels")
def _(s: SparkSession, d: str) -> DataFrame:
    ads, sensor, index = sku_tables(s, d)
    filled = [x for x in ads.columns if x not in ("Country", "customlabel1", "customlabel4")]
    ads = tables.drop_sparse_rows(ads, present=filled)
    labels = cleaning.repair_rows(ads, cleaning.SKU_DAILY).transform(cleaning.normalise_sku)
    return sku.with_custom_labels(sku.period_summary(ads, sensor, index, *ch.BASE), labels)


query("q19_spu_register")(lambda s, d: register.registered_spus(m.spu_register(s, d)))

# -- SKU pruning plan ----------------------------------------------------------


def _pruning_figures(s: SparkSession, d: str) -> DataFrame:
    return pruning.sku_figures(pruning.sku_months(*month_tables(s, d), ch.PRUNING), ch.PRUNING)


def _departments(s: SparkSession, d: str) -> DataFrame:
    """First-level categories of SKUs, from the SKU page's ads rows."""
    ads = m.ads_sku_daily(s, d).where(c(n.PT1).isNotNull()).select("SKU", "MC ID", n.PT1)
    return cleaning.normalise_sku(cleaning.strip_home_suffix(cleaning.strip_merchant_suffix(ads))).select("SKU", n.PT1).distinct()


@query("q20_spu_qualification")
def _(s: SparkSession, d: str) -> DataFrame:
    return pruning.spu_qualification(_pruning_figures(s, d), ch.PRUNING, _departments(s, d))


@query("q21_sku_family_share")
def _(s: SparkSession, d: str) -> DataFrame:
    figures = _pruning_figures(s, d)
    rows = pruning.above_family_share(figures, pruning.spu_qualification(figures, ch.PRUNING), ch.PRUNING)
    return rows.select("SPU", "SKU", "sku_mean_cost", "family_share", "above_share")


query("q22_gmv_trends")(lambda s, d: _pruning_figures(s, d).select("SPU", "SKU", "gmv_trend", "ads_value_trend"))


@query("q23_pruning_plan")
def _(s: SparkSession, d: str) -> DataFrame:
    delisted = m.product_label(s, d).where(c("customlabel1") == "clearance").select("SKU")
    return pruning.pruning_plan(*month_tables(s, d), ch.PRUNING, _departments(s, d), delisted)


# -- bands --------------------------------------------------------------------

query("k1_cost_band")(
    lambda s, d: counted(
        cleaning.clean_ads(m.ads_daily(s, d), cleaning.DAILY).withColumn("band", bands.cost_band(c("cost"))),
        "SKU", "band",
    )
)
query("k2_roi_band")(
    lambda s, d: _ratio(n.SENSOR_ROI, 1.0)(s, d)
    .withColumn("band", bands.roi_band(c(n.SENSOR_ROI))).select("SKU", "Date", "band")
)
query("k4_generation_flag")(
    lambda s, d: m.product_label(s, d)
    .select("SKU", bands.generation_flag(text.listing_generation(c("customlabel1"))).alias("flag"))
)
