"""Column rules, one test per trap."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from data import HOME, MAIN
from spendscope.functions import bands, conditions, dates, present, ratios, text

INF = float("inf")


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_sku_keeps_inner_tabs(spark):
    raw = [(" \ta\tb\nc\n ",), ("　x\x1f",), ("a1",), ("",), ("   ",)]
    got = values(spark, raw, "s string", text.normalise_sku(F.col("s")))
    assert got == ["A\tBC", "X", "A1", "", ""]


def test_sku_blanks_agree_with_python(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    got = values(spark, [(b + "a" + b,) for b in blanks], "s string", text.normalise_sku(F.col("s")))
    assert got == ["A"] * len(blanks)


def test_suffixes_are_cut_before_normalisation(spark):
    rows = [("x-hm-zz", HOME), ("x-HM", MAIN), ("x-hm ", MAIN), ("ab", HOME), ("x-hm", MAIN), (None, HOME)]
    merchant = text.merchant_sku(F.col("s"), F.col("m"))
    got = values(spark, rows, "s string, m long", text.normalise_sku(text.without_home_suffix(merchant)))
    assert got == ["X", "X-HM", "X-HM", "", "X", None]
    assert values(spark, rows[:2], "s string, m long", text.main_merchant(F.col("m"))) == [MAIN, MAIN]


def test_generation_order(spark):
    rows = [("2023-2022",), ("2022",), (None,), ("2021",)]
    got = values(spark, rows, "s string", text.listing_generation(F.col("s")))
    assert got == ["2023新品", "老品", "老品", "2021"]


def test_protected_and_raw_ratios(spark):
    rows = [(5.0, 0.0), (0.0, 0.0), (4.0, 2.0), (-5.0, 0.0), (None, 2.0), (INF, INF)]
    schema = "a double, b double"
    a, b = F.col("a"), F.col("b")
    assert values(spark, rows, schema, ratios.protected_ratio(a, b)) == [0, 0, 2, 0, 0, 0]
    assert values(spark, rows, schema, ratios.raw_ratio(a, b)) == [INF, None, 2, -INF, None, None]
    assert values(spark, rows[:3], schema, ratios.raw_ratio(a, b, 100.0)) == [INF, None, 200]


def test_relative_change(spark):
    rows = [(0.0, 5.0), (4.0, 5.0), (None, 5.0), (4.0, INF), (INF, 4.0)]
    got = values(spark, rows, "a double, b double", ratios.relative_change(F.col("a"), F.col("b")))
    assert got == [None, 0.25, None, INF, None]


def test_month_means_cover_thirteen_months(spark):
    rows = [(date(2023, 2, 1), 28.0), (date(2024, 1, 1), 31.0), (date(2024, 2, 1), 29.0), (date(2022, 12, 1), 31.0),
            (date(2023, 2, 2), 28.0)]
    got = values(spark, rows, "m date, v double", dates.monthly_to_daily(F.col("v"), F.col("m")))
    assert got == [1.0, 1.0, 29.0, 31.0, 28.0]


def test_dates(spark):
    assert dates.range_label("2023-01-02", date(2023, 1, 8)) == "2023-01-02至2023-01-08"
    assert values(spark, [(1,)], "x int", dates.range_divisor("2023-01-02", "2023-01-08")) == [6.0]
    days = [(date(2023, 1, 1),), (date(2023, 1, 2),), (date(2023, 1, 3),), (None,)]
    assert values(spark, days, "d date", dates.within(F.col("d"), "2023-01-01", "2023-01-02")) == [True, True, False, None]
    assert values(spark, days[:1], "d date", dates.iso(F.col("d"))) == ["2023-01-01"]


def test_conditions(spark):
    rows = [("US-Sofa",), ("us-bed",), (None,)]
    x = F.col("c")

    def hits(column):
        return [i for i, v in enumerate(values(spark, rows, "c string", column)) if v]

    assert hits(conditions.matches_all(x, ["us", "sofa"])) == [0]
    assert hits(conditions.matches_any(x, ["sofa", "bed"])) == [0, 1]
    assert hits(conditions.matches_none(x, ["bed"])) == [0]
    assert hits(conditions.Condition(("us",), ("sofa", "bed"), ("bed",)).on(x)) == [0]
    assert hits(conditions.Condition().on(x)) == [0, 1, 2]
    assert not conditions.Condition()


@pytest.mark.parametrize("cost, band", [
    (0.0, "none"), (None, "none"), (49.9, "low"), (50.0, "mid"), (149.9, "mid"), (150.0, "high"), (-1.0, "high"),
])
def test_cost_bands(spark, cost, band):
    assert values(spark, [(cost,)], "x double", bands.cost_band(F.col("x"))) == [band]


def test_other_bands(spark):
    roi = values(spark, [(1.4,), (1.5,), (2.5,), (2.6,)], "x double", bands.roi_band(F.col("x")))
    assert roi == ["weak", "none", "none", "strong"]
    change = values(spark, [(-0.1,), (0.0,), (0.1,), (None,), (0.00001,), (INF,)], "x double",
                    bands.change_direction(F.col("x")))
    assert change == ["down", "down", "up", "none", "down", "up"]
    flag = values(spark, [("2023新品",), ("老品",), ("other",)], "x string", bands.generation_flag(F.col("x")))
    assert flag == ["new", "old", "other"]


def test_report_text_agrees_with_python(spark):
    numbers = [0.125, 2.675, 0.5, 0.25, 1.005, 12345678.5, 0.0, -3.14159, 1e9, 123.0, 7530.575]
    rows = [(x,) for x in numbers]
    x = F.col("x")
    assert values(spark, rows, "x double", present.two_decimals(x)) == [f"{v:.2f}" for v in numbers]
    assert values(spark, rows, "x double", present.percent(x)) == [f"{v:.2%}" for v in numbers]
    assert values(spark, rows, "x double", present.as_is(x)) == [f"{v}" for v in numbers]
    odd = [(INF,), (-INF,), (None,)]
    assert values(spark, odd, "x double", present.two_decimals(x)) == ["inf", "-inf", None]
    assert values(spark, odd, "x double", present.percent(x)) == ["inf%", "-inf%", None]
    assert values(spark, odd, "x double", present.as_is(x)) == ["inf", "-inf", None]
    assert math.isinf(INF)


def test_text_of_very_large_and_very_small_numbers(spark):
    rows = [(1e26,), (1e-13,), (-2.5e30,), (1.25e-7,), (123456789.125,), (-0.0,), (1.7976931348623157e308,), (5e-324,), (1e7,), (None,)]
    got = values(spark, rows, "x double", present.as_is(F.col("x")))
    assert got[:7] == ["1" + "0" * 26 + ".0", "0.0000000000001", "-25" + "0" * 29 + ".0", "0.000000125", "123456789.125", "0.0", "17976931348623157" + "0" * 292 + ".0"]
    assert float(got[7]) == 5e-324 and got[8:] == ["10000000.0", None]
