"""Report plans on small tables with expected numbers typed in."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from data import DAY, ads, ads_campaign, ads_sku, index, label, records, sensor, sensor_campaign
from spendscope import names as n
from spendscope.functions.conditions import Condition
from spendscope.functions.present import as_text
from spendscope.operators import compare, matrix, rollup, series
from spendscope.plans import campaign, register, sku, spu, yearly

INF = float("inf")
NEXT = DAY + timedelta(days=1)


def spu_tables(spark):
    return (
        ads(spark, {"cost": 4.0, "click": 1.0, "impression": 4.0}, {"SKU": "B", "cost": 6.0, "Date": NEXT}),
        sensor(spark, {"Sale": 3.0, "UV": 100.0}, {"SKU": "B", "Date": NEXT, "UV": 0.0, "AddtoCart": 0.0}),
        index(spark, ("A", "s"), ("B", "t")),
        label(spark, {}),
    )


def test_daily_reports_scale_rates_by_hundred(spark):
    day = spu.day_detail(*spu_tables(spark), ["s", "t"])
    got = records(day, "Date", "费用", "神策ROI", "CPC", "CTR", "神策转化率", "神策加购率")
    assert got == [(DAY, 4.0, 12.5, 4.0, 25.0, 3.0, 2.0), (NEXT, 6.0, 50.0 / 6.0, 1.2, 5.0, INF, None)]
    assert tuple(day.columns) == ("Date", *n.DAY_REPORT)


def test_range_total_has_plain_rates(spark):
    total = spu.range_total(*spu_tables(spark), ["s"], DAY, DAY)
    assert records(total, "费用", "CTR", "神策转化率") == [(4.0, 0.25, 0.03)]
    nothing = spu.range_total(*spu_tables(spark), ["unknown"], DAY, DAY)
    assert records(nothing, "费用", "神策ROI", "CTR") == [(0.0, 0.0, None)]


def test_range_mean_divides_by_one_day_less(spark):
    tables = spu_tables(spark)
    mean = spu.range_mean(*tables, ["s", "t"], DAY, DAY + timedelta(days=6))
    total = spu.range_total(*tables, ["s", "t"], DAY, DAY + timedelta(days=6))
    for column in ("费用", "点击", "GMV", "UV"):
        assert records(mean, column)[0][0] * 6 == pytest.approx(records(total, column)[0][0])
    one_day = spu.range_mean(*tables, ["s"], DAY, DAY)
    # everything is infinite or missing then, and protected ratios fall to 0
    assert records(one_day, "费用", "神策ROI", "CPC", "CTR") == [(INF, 0.0, 0.0, None)]


def test_trend_and_drill_down(spark):
    tables = spu_tables(spark)
    trend = spu.spu_trend(*tables, DAY, NEXT)
    assert records(trend, "SPU", n.PT3, "费用") == [("s", "sofa", 4.0), ("t", "sofa", 6.0)]
    assert records(spu.spu_trend(*tables, DAY, NEXT, categories=["bed"])) == []
    skus = spu.spu_skus(*tables, ["t"], DAY, NEXT)
    assert records(skus, "SKU", "SPU", n.GENERATION, "费用") == [("B", "t", "老品", 6.0)]


def test_month_history(spark):
    month = date(2023, 2, 1)
    history = spu.month_history(
        ads(spark, {"Month": month, "cost": 28.0}, {"Month": date(2024, 2, 1), "cost": 29.0}, monthly=True),
        sensor(spark, {"Month": month, "GMV": 56.0}, monthly=True), index(spark, ("A", "s")), label(spark, {}), ["s"],
    )
    assert records(history, "Month", "日均费用", "日均GMV", "神策ROI") == [
        (month, 1.0, 2.0, 2.0), (date(2024, 2, 1), 29.0, 0.0, 0.0)]
    assert tuple(history.columns) == ("Month", *n.MONTH_REPORT)


def test_cost_matrix_and_strict_cells(spark):
    tables = (ads(spark, {"cost": 1.0}, {"cost": 2.0, "Country": "CA"}, {"cost": 60.0, "Date": NEXT}),
              *spu_tables(spark)[1:])
    cells = spu.spu_cost_matrix(*tables, ["s"], DAY, DAY + timedelta(days=2))
    days = matrix.days_between(DAY, DAY + timedelta(days=2))
    assert records(cells, "SPU", "SKU", n.GENERATION, *days) == [("s", "A", "老品", 3.0, 60.0, None)]
    assert records(cells, *[f"{d} band" for d in days]) == [("low", "mid", "none")]
    with pytest.raises(ValueError):
        spu.spu_cost_matrix(*tables, ["s"], DAY, NEXT, strict=True)
    single = (ads(spark, {"cost": 1.0}), *tables[1:])
    strict = spu.spu_cost_matrix(*single, ["s"], DAY, DAY, strict=True, bands=False)
    assert records(strict) == records(spu.spu_cost_matrix(*single, ["s"], DAY, DAY, bands=False))


def year_tables(spark):
    first, last = date(2023, 1, 1), date(2024, 1, 1)
    return (
        ads(spark, {"Month": first}, {"SKU": "B", "Month": first, "cost": 30.0, n.PT3: "bed"}, {"Month": last},
            {"SKU": "C", "Month": first}, monthly=True),
        sensor(spark, {"Month": first}, {"Month": last}, monthly=True),
        index(spark, ("A", "s"), ("B", "s"), ("C", "s")),
        label(spark, {"customlabel1": "2023"}, {"SKU": "B", n.PRICE: 5.0}, {"SKU": "C", n.PRICE: None}),
    )


def test_yearly_summary_and_lookup(spark):
    summary = yearly.yearly_summary(*year_tables(spark))
    # the unpriced SKU and the month after the year are out
    assert records(summary, "SKU", n.PRICE, "cost", "GMV", n.YEAR_SENSOR_ROI) == [
        ("A", 9.0, 10.0, 50.0, 5.0), ("B", 5.0, 30.0, 0.0, 0.0)]
    found = yearly.spu_lookup(summary, ["s"]).select("SKU", "roi_band", "generation_flag")
    assert [tuple(r) for r in found.collect()] == [("B", "weak", "old"), ("A", "strong", "new")]
    assert records(yearly.spu_category(summary, ["s"])) == [("SOFA",)]
    assert records(as_text(summary, n.YEAR_TEXT), "cost", "Sale", "CTR") == [("10.00", "1.0", "5.00%"), ("30.00", "0.0", "5.00%")]


def test_rollups_ignore_row_order(spark):
    rows = [{"SKU": random.choice("AB"), "cost": float(i), "Country": random.choice(["US", "CA"])} for i in range(30)]
    shuffled = random.sample(rows, len(rows))
    rest = spu_tables(spark)[1:]
    first, second = (spu.spu_trend(ads(spark, *r), *rest, DAY, NEXT) for r in (rows, shuffled))
    assert records(first) == records(second)


# -- SKU page -----------------------------------------------------------------


def test_conversion_of_the_sku_page_counts_payers(spark):
    rows = sku.period_summary(ads_sku(spark, {}), sensor_campaign(spark, {"UV": 100.0, "saleuser": 2.0, "sale": 3.0}),
                              index(spark, ("A", "s")), DAY, DAY)
    assert records(rows, "SKU", "SPU", "神策转化率", "神策加购率", "CTR", "神策ROI") == [("A", "s", 0.02, 0.02, 0.05, 5.0)]


def test_undefined_rates_drop_a_sku_and_infinite_ones_do_not(spark):
    rows = sku.period_summary(
        ads_sku(spark, {}, {"SKU": "B"}, {"SKU": "C"}, {"SKU": "D"}),
        sensor_campaign(spark, {"UV": 0.0, "saleuser": 0.0}, {"SKU": "B", "UV": 0.0},
                        {"SKU": "D", "UV": 0.0, "AddtoCart": 0.0}),
        index(spark, ("A", "s"), ("B", "s"), ("C", "s"), ("D", "s")), DAY, DAY,
    )
    assert records(rows, "SKU", "神策转化率") == [("B", INF)]


def test_totals_repeat_sensor_measures_per_category(spark):
    tables = (ads_sku(spark, {}, {n.PT3: "bed"}), sensor_campaign(spark, {"GMV": 10.0}), index(spark, ("A", "s")))
    totals = sku.compared_totals(*tables, (DAY, DAY), (NEXT, NEXT))
    assert records(totals, "row_kind", "GMV", "费用") == [("base", 20.0, 20.0), ("compare", 0.0, 0.0)]


def test_index_repeats_multiply_both_sides(spark):
    tables = (ads_sku(spark, {}), sensor_campaign(spark, {}), index(spark, ("A", "s"), ("A", "s"), ("A", "t")))
    rows = sku.period_summary(*tables, DAY, DAY)
    assert records(rows, "SPU", "费用", "GMV") == [("s", 20.0, 100.0), ("t", 10.0, 50.0)]


def campaign_sensors(spark):
    return sensor_campaign(
        spark, {"Campaign": "us-sofa", "GMV": 1.0}, {"Campaign": "us-bed", "GMV": 2.0}, {"Campaign": None, "GMV": 4.0},
        {"Campaign": "us-sofa", "GMV": 8.0, "Date": NEXT}, {"Campaign": "us-bed", "GMV": 16.0, "Date": NEXT},
    )


@pytest.mark.parametrize("skus, both, expected", [
    (None, False, (1.0, 24.0)), (["A"], False, (1.0, 8.0)), (None, True, (1.0, 8.0)),
])
def test_condition_restricts_the_comparison_only_with_a_sku_list(spark, skus, both, expected):
    tables = (ads_sku(spark, {}, {"Date": NEXT}), campaign_sensors(spark), index(spark, ("A", "s")))
    totals = sku.compared_totals(*tables, (DAY, DAY), (NEXT, NEXT), skus=skus,
                                 condition=Condition(all_of=("SOFA",)), filter_compare=both)
    # ads cost is never restricted by campaigns
    assert records(totals, "row_kind", "GMV", "费用") == [("base", expected[0], 10.0), ("compare", expected[1], 10.0)]


def test_sku_lists_may_be_frames(spark):
    tables = (ads_sku(spark, {}, {"SKU": "B"}), sensor_campaign(spark, {}, {"SKU": "B"}),
              index(spark, ("A", "s"), ("B", "s")))
    keys = index(spark, ("B", None)).select("SKU")
    by_list = sku.period_summary(*tables, DAY, DAY, skus=["B"])
    assert records(by_list) == records(sku.period_summary(*tables, DAY, DAY, skus=keys))
    assert records(by_list, "SKU") == [("B",)]


def test_overlapping_periods_count_rows_twice(spark):
    tables = (ads_sku(spark, {}, {"Date": NEXT}), sensor_campaign(spark, {}, {"Date": NEXT}), index(spark, ("A", "s")))
    totals = sku.compared_totals(*tables, (DAY, NEXT), (NEXT, NEXT))
    assert records(totals, "row_kind", "费用", "GMV") == [("base", 20.0, 100.0), ("compare", 10.0, 50.0)]


def test_change_row_follows_from_the_two_rows(spark):
    tables = (ads_sku(spark, {}, {"Date": NEXT, "cost": 15.0, "conversions": 0.0}),
              sensor_campaign(spark, {"sale": 0.0}, {"Date": NEXT}), index(spark, ("A", "s")))
    rows = {r["row_kind"]: r for r in sku.compare_periods(*tables, (DAY, DAY), (NEXT, NEXT)).collect()}
    base, other, change = rows["base"], rows["compare"], rows["change"]
    for metric in compare.METRICS:
        expected = None if base[metric] == 0 else pytest.approx((other[metric] - base[metric]) / base[metric])
        assert change[metric] == expected
    assert change["销量"] is None and change["费用"] == 0.5 and change[n.DATE_RANGE] == "对比"
    totals = sku.compared_totals(*tables, (DAY, DAY), (NEXT, NEXT))
    text = {r["row_kind"]: r for r in compare.comparison_text(totals).collect()}
    assert (text["base"]["费用"], text["compare"]["UV"], text["base"]["点击率"]) == ("10.00", "10.0", "5.00%")
    assert (text["change"]["费用"], text["change"]["销量"]) == ("50.00%", "")
    directions = compare.change_directions(compare.with_change_row(totals)).first()
    assert directions["费用 direction"] == "up" and directions["ads转化 direction"] == "down"
    assert directions["销量 direction"] == "none"


def test_undefined_change_prints_nan(spark):
    tables = (ads_sku(spark, {}), sensor_campaign(spark, {}), index(spark, ("A", "s")))
    text = compare.comparison_text(sku.compared_totals(*tables, (NEXT, NEXT), (DAY, DAY))).collect()
    change = {r["row_kind"]: r for r in text}["change"]
    assert change["CPC"] == "nan%" and change["费用"] == ""


def test_sku_matrix(spark):
    rows = ads_sku(spark, {"cost": 1.0}, {"cost": 2.0, n.PT3: "bed"}, {"Date": NEXT}, {"SKU": "B"})
    assert records(sku.sku_cost_matrix(rows, index(spark), ["A"], DAY, NEXT)) == [("A", 3.0, 10.0)]
    twice = index(spark, ("A", "s"), ("A", "t"))
    assert records(sku.sku_cost_matrix(rows, twice, ["A"], DAY, NEXT)) == [("A", 6.0, 20.0)]
    with pytest.raises(ValueError):
        sku.sku_cost_matrix(rows, index(spark), ["A"], DAY, NEXT, strict=True)
    assert records(sku.sku_cost_matrix(rows, index(spark), ["A"], NEXT, NEXT, strict=True)) == [("A", 10.0)]


def test_custom_labels(spark):
    rows = ads_sku(spark, {"customlabel2": "x"}, {"customlabel2": "z"}, {"customlabel2": "z"}, {"customlabel4": None})
    summary = sku.period_summary(rows, sensor_campaign(spark, {}), index(spark, ("A", "s")), DAY, DAY)
    labelled = sku.with_custom_labels(summary, rows)
    assert records(labelled, "SKU", "费用", "customlabel2", "customlabel4") == [("A", 40.0, "x", "y"), ("A", 40.0, "z", "y")]
    # the same rows as one representative per full key
    joined = summary.join(rows.select("SKU", "customlabel2", "customlabel4"), "SKU", "left")
    keys = ["SPU", "SKU", "费用", "GMV", "点击", "支付用户数", "神策ROI", "ads ROI", "customlabel2", "customlabel4",
            n.PT1, n.PT2, n.PT3, n.GENERATION, "神策加购率", "神策转化率"]
    assert records(rollup.first_rows(joined, keys).select(*[f"`{c}`" for c in labelled.columns])) == records(labelled)


# -- campaign page ------------------------------------------------------------


def series_tables(spark):
    rnd = random.Random(3)
    facts = [{"SKU": rnd.choice(["A", "A", "A", "B"]), "Campaign": rnd.choice(["c", "d"]), "Campaign ID": rnd.randint(1, 3),
              "Date": DAY + timedelta(days=rnd.randint(0, 3)), "cost": float(rnd.randint(0, 9)),
              "clicks": float(rnd.randint(0, 3)), "Country": rnd.choice(["US", "CA", "MX"])} for _ in range(60)]
    visits = [{"SKU": rnd.choice(["A", "B"]), "Campaign": rnd.choice(["c", "d"]), "Campaign ID": rnd.randint(1, 3),
               "Date": DAY + timedelta(days=rnd.randint(0, 3)), "GMV": float(rnd.randint(0, 9))} for _ in range(25)]
    return (ads_campaign(spark, *facts), sensor_campaign(spark, *visits), index(spark, ("A", "s"), ("A", "t")),
            label(spark, {}, {"SKU": "B", "imagelink": None}))


LAST = DAY + timedelta(days=3)
PRODUCT = [f"`{c}`" for c in series.PRODUCT]


def brute_force_series(tables):
    """Lists per product and day from the full joined rows, built row by row; totals per product."""
    points, totals = {}, {}
    for r in campaign.enriched_rows(*tables).collect():
        product = tuple(r[c] for c in series.PRODUCT)
        cpc = r["cost"] / r["clicks"] if r["clicks"] else 0.0
        point = points.setdefault((product, r["Date"]), {}).setdefault(cpc, [0.0] * len(series.POINT_MEASURES))
        for i, measure in enumerate(series.POINT_MEASURES):
            point[i] += r[measure]
        sums = totals.setdefault(product, [0.0, 0.0])
        sums[0] += r["GMV"]
        sums[1] += r["cost"]
    return {
        (product, day): ([sorted(rows), *[[rows[k][i] for k in sorted(rows)] for i in range(len(series.POINT_MEASURES))]], totals[product])
        for (product, day), rows in points.items()
    }


def day_rows(tables):
    return {
        (tuple(r[c] for c in series.PRODUCT), r["Date"]): ([r[c] for c in series.SERIES], [r["gmv_sum"], r["cost_sum"]])
        for r in campaign.campaign_day_series(*tables, DAY, LAST).collect()
    }


def series_rows(tables):
    rows = campaign.campaign_series(*tables, DAY, LAST).collect()
    out = {tuple(r[c] for c in series.PRODUCT): ([r[c] for c in ("Date", *series.SERIES)], [r["gmv_sum"], r["cost_sum"]]) for r in rows}
    assert len(out) == len(rows)  # one row per product
    return out


def joined_by_product(days):
    """Rows per product and day, put in day order and joined end to end."""
    out = {}
    for (product, day), (lists, totals) in sorted(days.items(), key=lambda x: x[0][1]):
        series_lists, _ = out.setdefault(product, ([[] for _ in range(1 + len(lists))], totals))
        for whole, part in zip(series_lists, ([day.isoformat()] * len(lists[0]), *lists)):
            whole.extend(part)
    return out


def test_series_equal_brute_force(spark):
    tables = series_tables(spark)
    by_hand = brute_force_series(tables)
    assert day_rows(tables) == by_hand
    assert series_rows(tables) == joined_by_product(by_hand)


def test_series_lists_of_a_product_are_aligned_and_ordered(spark):
    for product, (lists, (gmv, cost)) in series_rows(series_tables(spark)).items():
        assert len({len(x) for x in lists}) == 1 and len(lists) == 12
        assert list(zip(lists[0], lists[1])) == sorted(zip(lists[0], lists[1]))
        measures = dict(zip(series.POINT_MEASURES, lists[2:]))
        assert sum(measures["GMV"]) == pytest.approx(gmv) and sum(measures["cost"]) == pytest.approx(cost)


def test_series_with_a_hot_product_and_with_no_rows(spark):
    tables = series_tables(spark)
    more = ads_campaign(spark, *[{"SKU": "A", "Campaign": f"x{i}", "Date": DAY + timedelta(days=i % 4), "cost": float(i), "clicks": 1.0} for i in range(400)])
    before, after = series_rows(tables), series_rows((tables[0].unionByName(more), *tables[1:]))
    assert set(after) >= set(before) and all(after[k] == v for k, v in before.items() if k[0] != "A")
    assert {len(after[k][0][0]) >= 399 for k in after if k[0] == "A"} == {True}
    assert campaign.campaign_series(*tables, "2020-01-01", "2020-01-02").count() == 0


def test_rows_added_to_one_sku_change_no_other_row_and_no_grain(spark):
    tables = series_tables(spark)
    more = ads_campaign(spark, *[{"SKU": "A", "Campaign": f"x{i}", "Date": DAY, "cost": float(i), "clicks": 1.0} for i in range(300)])
    before, after = day_rows(tables), day_rows((tables[0].unionByName(more), *tables[1:]))
    keys = lambda rows: {(p[0], day) for p, day in rows}
    assert keys(after) - keys(before) <= {("A", DAY)}
    assert all(after[k] == v for k, v in before.items() if k[0][0] != "A")


def test_series_totals_and_points(spark):
    tables = series_tables(spark)
    rows = campaign.campaign_day_series(*tables, DAY, LAST)
    totals = series.product_totals(campaign.folded_rows(*tables, DAY, LAST))
    assert records(totals) == records(rows.select(*PRODUCT, "cost_sum", "gmv_sum").distinct())
    assert records(totals) == records(campaign.campaign_series(*tables, DAY, LAST).select(*PRODUCT, "cost_sum", "gmv_sum"))
    points = campaign.campaign_points(*tables, DAY, LAST)
    assert points.count() == sum(len(r["cost"]) for r in rows.collect())
    assert {(r["SKU"], r["points"]) for r in points.groupBy("SKU", *PRODUCT[1:]).count().withColumnRenamed("count", "points").collect()} == {
        (r["SKU"], r["points"]) for r in rows.collect()}


def test_series_of_chosen_campaigns(spark):
    tables = series_tables(spark)
    narrowed = (tables[0].where("Campaign = 'c'"), *tables[1:])
    chosen = campaign.campaign_series(*tables, DAY, LAST, campaigns=["c"])
    assert records(chosen) == records(campaign.campaign_series(*narrowed, DAY, LAST))
    assert records(campaign.campaigns_in_range(tables[0], DAY, LAST)) == [("c",), ("d",)]
    assert records(campaign.campaigns_in_range(tables[0], "2020-01-01", "2020-01-02")) == []


def test_register(spark):
    df = spark.createDataFrame([("s", "img"), (None, "img")], f"SPU string, `{n.IMAGE}` string")
    assert records(register.registered_spus(df)) == [("s", "img")]


def test_campaigns_dearest_first(spark):
    rows = [{"SKU": f"S{i}", "cost": float(c)} for i, c in enumerate([3, 9, 1, 7])]
    tables = (ads(spark, *[{**r, "Month": DAY} for r in rows], monthly=True), sensor(spark, monthly=True),
              index(spark, *[(f"S{i}", "s") for i in range(4)]), label(spark, *[{"SKU": f"S{i}"} for i in range(4)]))
    summary = yearly.yearly_summary(*tables)
    assert [r["SKU"] for r in yearly.by_spu(summary).collect()] == ["S0", "S1", "S2", "S3"]
    assert "Sort [" not in summary._jdf.queryExecution().optimizedPlan().toString()
    assert [r["SKU"] for r in yearly.spu_lookup(summary, ["s"]).collect()] == ["S1", "S3", "S0", "S2"]


def test_matrix_without_a_range_spans_all_days(spark):
    last = DAY + timedelta(days=4)
    tables = ads(spark, {}, {"Date": last}), sensor(spark), index(spark, ("A", "s")), label(spark, {})
    whole, ranged = spu.spu_cost_matrix(*tables, ["s"]), spu.spu_cost_matrix(*tables, ["s"], DAY, last)
    assert whole.columns == ranged.columns and records(whole) == records(ranged)
