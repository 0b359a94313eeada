from datetime import date

from data import DAY, HOME, MAIN, ads, ads_campaign, ads_sku, index, records
from spendscope import names as n
from spendscope.operators import cleaning as c, rollup
from spendscope.sources.tables import drop_missing, drop_sparse_rows


def test_rows_without_a_key_are_left_out(spark):
    rows = ads(spark, {"Country": None}, {n.PT3: None}, {"Date": None}, {"SKU": None}, {"MC ID": None}, {"SKU": "B"})
    assert records(c.clean_ads(rows, c.DAILY), "SKU") == [("B",)]
    assert records(c.clean_ads(rows, c.DAILY, merge=False), "SKU") == [("B",)]


def test_sum_of_nothing_is_zero(spark):
    rows = ads(spark, {"cost": None}, {"cost": None})
    assert records(c.clean_ads(rows, c.DAILY), "cost", "click") == [(0.0, 10.0)]


def test_normalisation_follows_the_merge(spark):
    rows = ads(spark, {"SKU": "a1"}, {"SKU": "A1 "}, {"SKU": "A1 ", "cost": 1.0}, {"SKU": "a1", "Country": "CA"})
    assert records(c.clean_ads(rows, c.DAILY), "SKU", "cost") == [("A1", 10.0), ("A1", 10.0), ("A1", 11.0)]


def test_suffix_and_merchant_rules_merge_rows(spark):
    rows = ads(spark, {"SKU": "x-hm-zz", "MC ID": HOME}, {"SKU": "x", "MC ID": MAIN}, {"SKU": "ab", "MC ID": HOME})
    assert records(c.clean_ads(rows, c.DAILY), "SKU", "cost") == [("", 10.0), ("X", 20.0)]


def test_exchange_rates(spark):
    assert records(c.clean_ads(ads(spark, {"Currency": "HKD", "cost": 100.0}), c.DAILY), "cost") == [(12.7,)]
    assert records(c.clean_ads(ads_sku(spark, {"Currency": "HKD", "cost": 100.0}), c.SKU_DAILY), "cost") == [(13.0,)]
    campaign = c.clean_ads(ads_campaign(spark, {"currency": "HKD", "cost": 100.0, "value": 200.0}), c.CAMPAIGN)
    assert records(campaign, "cost", "value") == [(12.7, 25.4)]


def test_sku_page_labels_before_the_merge(spark):
    rows = ads_sku(spark, {"customlabel1": None}, {"customlabel1": "2022-x"}, {"customlabel1": "2023"})
    got = c.clean_ads(rows, c.SKU_DAILY)
    assert records(got, n.GENERATION, "cost") == [("2023新品", 10.0), ("老品", 20.0)]
    assert not {"MC ID", "Currency", "Country"} & set(got.columns)


def test_only_keeps_whole_merge_groups(spark):
    rows = ads(spark, {"SKU": " a\n"}, {"SKU": "A", "Country": "CA"}, {"SKU": "b"}, {"SKU": None})
    kept = c.clean_ads(rows, c.DAILY, only=index(spark, ("A", "s")).select("SKU"))
    assert records(kept, "SKU", "cost") == [("A", 10.0), ("A", 10.0)]


def test_unmerged_rows_have_the_same_sums(spark):
    rows = ads(spark, {"cost": 1.5}, {"cost": 2.5}, {"SKU": "B", "cost": None}, {"SKU": "a ", "Country": "CA"})
    sums = [
        records(rollup.group_sum(c.clean_ads(rows, c.DAILY, merge=m), ["SKU", "Date"], n.ADS_MEASURES))
        for m in (True, False)
    ]
    assert sums[0] == sums[1]


def test_month_shape(spark):
    rows = ads(spark, {"Month": date(2023, 1, 1)}, {"Month": date(2023, 2, 1)}, {}, {}, monthly=True)
    got = c.clean_ads(rows, c.MONTHLY)
    assert records(got, "Month", "cost") == [(date(2023, 1, 1), 10.0), (date(2023, 2, 1), 10.0), (DAY, 20.0)]


def test_sparse_rows(spark):
    df = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, None, None), ("c", None, None, None)],
                               "k string, x int, y int, z int")
    assert records(drop_sparse_rows(df), "k") == [("a",), ("b",)]
    assert records(drop_sparse_rows(df, present=["k"]), "k") == [("a",), ("b",)]
    assert records(drop_sparse_rows(df.select("k", "x")), "k") == [("a",), ("b",), ("c",)]
    assert records(drop_missing(df, "x"), "k") == [("a",), ("b",)]
