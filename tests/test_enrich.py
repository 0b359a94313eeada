import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from data import DAY, ads, ads_campaign, index, label, records, sensor, sensor_campaign
from spendscope import names as n
from spendscope.operators import cleaning, enrich, rollup
from spendscope.plans import campaign, spu

ALL = spu.ALL_MEASURES


def test_repeated_index_rows_repeat_ads_and_sensor_rows(spark):
    tables = ads(spark, {}), sensor(spark, {}), index(spark, ("A", "s1"), ("A", "s2")), label(spark)
    rows = spu.enriched_rows(*tables)
    # two ads rows meet two copies of the sensor row
    assert records(rows, "SPU", "GMV") == [("s1", 50.0)] * 2 + [("s2", 50.0)] * 2
    assert records(rollup.duplicate_keys(tables[2], ["SKU"])) == [("A", 2)]


def test_label_and_sensor_skus_are_taken_as_they_are(spark):
    rows = spu.enriched_rows(ads(spark, {"SKU": "abc"}), sensor(spark, {"SKU": "abc"}),
                             index(spark, (" abc\n", "s")), label(spark, {"SKU": "abc", "customlabel1": "2023"}))
    assert records(rows, "SKU", "SPU", n.GENERATION, n.PRICE, "GMV") == [("ABC", "s", "老品", None, None)]


def test_missing_skus_change_nothing(spark):
    clean = [ads(spark, {}), sensor(spark, {}), index(spark, ("A", "s")), label(spark, {})]
    dirty = [clean[0], sensor(spark, {}, {"SKU": None}), index(spark, ("A", "s"), (None, "s")),
             label(spark, {}, {"SKU": None})]
    assert records(spu.enriched_rows(*clean)) == records(spu.enriched_rows(*dirty))
    folded = [records(rollup.group_sum(spu.folded_rows(*t), ["SPU"], ALL)) for t in (clean, dirty)]
    assert folded[0] == folded[1]


def _random_tables(spark, seed):
    rnd = random.Random(seed)
    skus = ["a", "A ", "b", "C", "d-hm", "hot"]
    days = [DAY + timedelta(days=i) for i in range(3)]

    def sku():
        return "hot" if rnd.random() < 0.4 else rnd.choice(skus)

    def number():
        return rnd.choice([None, 0.0, float(rnd.randint(1, 9))])

    facts = [{"SKU": sku(), "Date": rnd.choice(days), "Country": rnd.choice(["US", "CA", None]),
              "Currency": rnd.choice(["USD", "HKD"]), n.PT3: rnd.choice(["sofa", "bed"]), "cost": number(),
              "click": number()} for _ in range(60)]
    visits = [{"SKU": rnd.choice(["A", "B", "C", "HOT", None]), "Date": rnd.choice(days), "GMV": number(),
               "UV": number()} for _ in range(40)]
    pairs = [(rnd.choice(["a", "B\n", "C", "hot", None]), rnd.choice(["s1", "s2", None])) for _ in range(14)]
    labels = [{"SKU": rnd.choice(["A", "B", "HOT"]), "customlabel1": rnd.choice(["2023", "2022", "x", None]),
               n.PRICE: rnd.choice([1.0, 2.0, None])} for _ in range(8)]
    return ads(spark, *facts), sensor(spark, *visits), index(spark, *pairs), label(spark, *labels)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("keys, options", [
    (("SPU", n.PT3), {}),
    (("Date",), {}),
    (("SKU", "SPU", n.PT3, n.GENERATION), {"generation": True}),
    (("SPU", "SKU", n.PT3, n.GENERATION, n.PRICE), {"generation": True, "attributes": (n.PRICE,)}),
])
def test_folded_sums_equal_full_sums(spark, seed, keys, options):
    tables = _random_tables(spark, seed)
    full = rollup.group_sum(spu.enriched_rows(*tables), keys, ALL)
    folded = rollup.group_sum(spu.folded_rows(*tables, **options), keys, ALL)
    rounded = [F.round(F.col(f"`{m}`"), 6).alias(m) for m in ALL]
    assert records(full.select(*keys, *rounded)) == records(folded.select(*keys, *rounded))
    rows = spu.enriched_rows(*tables).count()
    assert spu.folded_rows(*tables, **options).agg(F.sum("joined_rows")).first()[0] == rows


def test_folded_sums_of_chosen_spus(spark):
    tables = _random_tables(spark, 7)
    full = rollup.group_sum(spu.enriched_rows(*tables).where("SPU = 's1'"), ["SPU", "Date"], ALL)
    chosen = rollup.group_sum(spu.folded_rows(*tables, spus=["s1"]), ["SPU", "Date"], ALL)
    keys = index(spark, ("s1", "unused")).select(F.col("SKU").alias("spu_key"))
    by_frame = rollup.group_sum(spu.folded_rows(*tables, spus=keys), ["SPU", "Date"], ALL)
    shown = [[tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in records(df)]
             for df in (full, chosen, by_frame)]
    assert shown[0] == shown[1] == shown[2]


def test_a_hot_key_is_one_row_in_every_join(spark):
    copies = 200
    tables = (ads(spark, {}), sensor(spark, *[{}] * copies), index(spark, *[("A", "s")] * copies),
              label(spark, *[{}] * 3))
    folded = spu.folded_rows(*tables)
    assert folded.count() == 1
    expected = copies * 3 * copies * copies * 3  # ads copies times sensor copies
    assert folded.select("joined_rows", "cost", "GMV").first() == (expected, 10.0 * expected, 50.0 * expected)


def test_sensor_rows_repeat_per_product_row_only_where_they_match(spark):
    rows = spu.enriched_rows(ads(spark, {}, {"SKU": "B"}, {"SKU": "C"}), sensor(spark, {}, {}, {"SKU": "C"}),
                             index(spark, ("A", "s1"), ("A", "s2"), ("B", "s3"), ("B", "s4")), label(spark, {}, {}))
    # two ads products of A times two visits times four product rows; B has no visit, C no product
    assert sorted(records(rows.groupBy("SKU").count())) == [("A", 4 * 2 * 4), ("B", 2), ("C", 1)]
    assert rows.columns == spu.enriched_rows(ads(spark, {}), sensor(spark, {}), index(spark), label(spark), False).columns


def test_campaign_rows_are_sorted_and_filled(spark):
    first, second = date(2023, 6, 1), date(2023, 6, 2)
    rows = enrich.presented(campaign.enriched_rows(
        ads_campaign(spark, {"Date": first}, {"Date": second}, {"SKU": "B"}),
        sensor_campaign(spark, {"Date": first, "Campaign ID": 2}, {"Date": second}),
        index(spark, ("A", "s")), label(spark, {}),
    ))
    got = [tuple(r) for r in rows.select("SKU", "Date", "SPU", "image", n.PRICE, "GMV", n.GENERATION).collect()]
    assert got == [
        ("A", second, "s", "img", 9.0, 50.0, "老品"),
        ("A", first, "s", "img", 9.0, 0.0, "老品"),
        ("B", first, "0", "0", 0.0, 0.0, "老品"),
    ]


def test_campaign_sensor_rows_do_not_repeat_by_products(spark):
    rows = campaign.enriched_rows(ads_campaign(spark, {}), sensor_campaign(spark, {}),
                                  index(spark, ("A", "s1"), ("A", "s2")), label(spark, {}))
    assert records(rows, "SPU", "GMV") == [("s1", 50.0), ("s2", 50.0)]
    assert records(cleaning.clean_ads(ads_campaign(spark, {}), cleaning.CAMPAIGN), "clicks") == [(5.0,)]
    assert records(enrich.fill_missing(rows), "SPU", "GMV") == records(rows, "SPU", "GMV")
