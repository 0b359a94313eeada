import math
import random
import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import ads, index, label, records, sensor
from spendscope import names as n
from spendscope.functions import trend
from spendscope.plans import pruning
from spendscope.sources.keys import without

RULES = pruning.Rules(categories=("Sofa",), left_out=("Outdoor",))


def month(i):
    return date(2023, i, 1)


def tables(spark, facts, visits=(), labels=({},), pairs=(("A", "s"), ("B", "s"))):
    """Monthly tables; facts are (sku, month, cost, value[, click, impression])."""
    rows = [{"SKU": f[0], "Month": month(f[1]), "cost": float(f[2]), "ads value": float(f[3]), **dict(zip(("click", "impression"), map(float, f[4:])))} for f in facts]
    seen = [{"SKU": v[0], "Month": month(v[1]), "GMV": float(v[2])} for v in visits]
    return ads(spark, *rows, monthly=True), sensor(spark, *seen, monthly=True), index(spark, *pairs), label(spark, *labels)


def figures(spark, *args, **more):
    t = tables(spark, *args, **more)
    return pruning.sku_figures(pruning.sku_months(*t, RULES), RULES)


def one(df, **keys):
    rows = [r.asDict() for r in df.collect() if all(r[k] == v for k, v in keys.items())]
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("cost, gmv, expected", [
    (600.0, 1000.0, (False, True, True)),  # a mean of 50 is not above 50
    (600.12, 1000.0, (True, True, True)),
    (600.12, 60_000.0, (True, False, False)),  # a mean of 5000 is not below 5000
    (30_000.0, 59_999.0, (True, True, True)),
    (1000.0, 2000.0, (True, True, False)),  # a return of 2 is not below 2
    (1000.0, 1999.0, (True, True, True)),
])
def test_bounds_themselves_do_not_qualify(spark, cost, gmv, expected):
    found = figures(spark, [("A", 1, cost / 2, 1), ("B", 1, cost / 2, 1)], [("A", 1, gmv / 2), ("B", 1, gmv / 2)])
    row = one(pruning.spu_qualification(found, RULES), SPU="s")
    assert (row["costs_enough"], row["earns_little"], row["returns_little"]) == expected
    assert row["qualified"] == all(expected) and row["sku_count"] == 2


def test_return_leaves_december_out(spark):
    found = figures(spark, [("A", 1, 1000, 1), ("B", 12, 1000, 1)], [("A", 1, 1000), ("B", 12, 9000)])
    row = one(pruning.spu_qualification(found, RULES), SPU="s")
    assert row["return"] == 1.0 and row["mean_gmv"] == pytest.approx(10_000 / 12)


@pytest.mark.parametrize("skus, least, has", [(1, 2, False), (2, 2, True), (3, 4, False)])
def test_skus_are_counted_once(spark, skus, least, has):
    facts = [(f"S{i}", k, 900, 1) for i in range(skus) for k in (1, 2, 3)]
    found = figures(spark, facts, pairs=[(f"S{i}", "s") for i in range(skus)])
    row = one(pruning.spu_qualification(found, pruning.Rules(categories=("sofa",), least_skus=least)), SPU="s")
    assert row["sku_count"] == skus and row["has_skus"] == has and row["qualified"] == has


def test_categories_and_departments(spark):
    found = figures(spark, [("A", 1, 900, 1), ("B", 1, 900, 1)])
    out = frame_of(spark, [("A", " OUTDOOR "), ("B", "Indoor")])
    assert one(pruning.spu_qualification(found, RULES), SPU="s")["qualified"]
    assert not one(pruning.spu_qualification(found, RULES, out), SPU="s")["qualified"]
    assert one(pruning.spu_qualification(found, RULES, out.where("SKU = 'B'")), SPU="s")["qualified"]
    none = pruning.sku_figures(pruning.sku_months(*tables(spark, [("A", 1, 900, 1)]), RULES), pruning.Rules(categories=("bed",)))
    assert not one(pruning.spu_qualification(none, RULES), SPU="s")["in_category"]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, f"SKU string, `{n.PT1}` string")


def test_share_is_the_family_mean_over_its_skus(spark):
    found = figures(spark, [("A", 1, 900, 1), ("B", 1, 300, 1), ("C", 5, 600, 1)], pairs=[("A", "s"), ("B", "s"), ("C", "s")])
    rows = {r["SKU"]: r for r in pruning.above_family_share(found, pruning.spu_qualification(found, RULES), RULES).collect()}
    assert {k: (r["sku_mean_cost"], r["family_share"], r["above_share"]) for k, r in rows.items()} == {
        "A": (75.0, 50.0, True), "B": (25.0, 50.0, False), "C": (50.0, 50.0, False)}  # its share itself is not above it


def test_no_window_over_facts(spark):
    t = tables(spark, [("A", 1, 900, 1)])
    found = pruning.sku_figures(pruning.sku_months(*t, RULES), RULES)
    rows = pruning.above_family_share(found, pruning.spu_qualification(found, RULES), RULES)
    text = rows._jdf.queryExecution().executedPlan().toString()
    for window in re.findall(r"Window \[.*", text):
        assert re.search("_copies", window), window  # copies of product rows only


def test_top_of_each_task_meets_and_no_family_is_sorted_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("cold").alias("SPU"), F.concat(F.lit("S"), "id").alias("SKU"), *[F.col("id").cast("double").alias(c) for c in pruning.PRIORITY])
    top = pruning.weakest(df, 3)
    text = top._jdf.queryExecution().executedPlan().toString()
    partial, final = text.index("Partial"), text.index("Final")
    assert "WindowGroupLimit" in text and final < text.index("Exchange") < partial  # the limit below the shuffle
    assert [(r["SKU"], r["rank"]) for r in top.where("SPU = 'hot'").orderBy("rank").collect()] == [("S0", 1), ("S1", 2), ("S2", 3)]


def test_ties_go_on_to_the_next_figure_and_missing_ones_come_last(spark):
    rows = [("s", "A", 1.0, 2.0, 0.0, 0.0, None), ("s", "B", 1.0, 2.0, 0.0, 0.0, 0.5), ("s", "C", 1.0, 1.0, 9.0, 9.0, 9.0),
            ("s", "E", 1.0, 2.0, 0.0, 0.0, 0.5), ("s", "D", 0.5, 9.0, 9.0, 9.0, 9.0), ("t", "A", 1.0, 1.0, 1.0, 1.0, math.inf)]
    df = spark.createDataFrame(rows, "SPU string, SKU string, " + ", ".join(f"{c} double" for c in pruning.PRIORITY))
    got = {(r["SPU"], r["rank"]): r["SKU"] for r in pruning.weakest(df, 10).collect()}
    assert got == {("s", 1): "D", ("s", 2): "C", ("s", 3): "B", ("s", 4): "E", ("s", 5): "A", ("t", 1): "A"}


def test_trends_equal_a_fit_with_gaps_as_zeros(spark):
    rnd = random.Random(1)
    facts = [("A", k, 10, rnd.randint(0, 50)) for k in (1, 7, 8, 8, 11)] + [("B", 12, 10, 7)]
    visits = [("A", k, rnd.randint(0, 90)) for k in (6, 7, 8, 11, 12)] + [("B", 12, 30)]
    t = tables(spark, facts, visits)
    rows = {r["SKU"]: r for r in pruning.sku_figures(pruning.sku_months(*t, RULES), RULES).collect()}
    for sku in "AB":
        value, gmv = np.zeros(13), np.zeros(13)
        for s, k, _, v in facts:
            value[k] += v * (s == sku)
        held = {(s, k) for s, k, *_ in facts}
        for s, k, v in visits:
            gmv[k] += v * (s == sku and (s, k) in held)  # sensor rows without an ads row do not count
        assert rows[sku]["ads_value_trend"] == pytest.approx(np.polyfit(range(6), value[7:], 1)[0])
        assert rows[sku]["gmv_trend"] == pytest.approx(np.polyfit(range(6), gmv[7:], 1)[0])


def test_slope_of_present_points(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.5), ("a", 4.0, 5.0), ("a", None, 9.0), ("a", 3.0, None), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(trend.slope_of(F.col("x"), F.col("y")).alias("s")).collect()}
    assert got["a"] == pytest.approx(np.polyfit([1, 2, 4], [2, 4.5, 5], 1)[0]) and got["b"] is None and got["c"] is None
    assert df.groupBy("k").agg(trend.slope_with_gaps(F.col("x"), F.col("y"), 3, 3).alias("s")).first()["s"] is None


def test_plan_from_end_to_end(spark):
    pairs = [(x, "s") for x in "ABCD"] + [("X", "t"), ("Y", "t")]
    facts = [("A", 1, 800, 10), ("B", 1, 900, 5), ("C", 1, 10, 5), ("D", 1, 900, 0), ("X", 1, 100, 5), ("Y", 1, 1, 5)]
    t = tables(spark, facts, [("A", 1, 50), ("B", 1, 20)], pairs=pairs)
    plan = pruning.pruning_plan(*t, RULES, most=2)
    assert records(plan.select("SPU", "SKU", "rank")) == [("s", "B", 2), ("s", "D", 1)]  # t costs too little, C less than its share
    assert records(pruning.pruning_plan(*t, RULES, delisted=["D"], most=2).select("SKU", "rank")) == [("A", 2), ("B", 1)]
    gone = spark.createDataFrame([("D",), ("B",)], "x string")
    assert records(pruning.pruning_plan(*t, RULES, delisted=gone).select("SKU", "rank")) == [("A", 1)]


def test_empty_tables_and_key_lists(spark):
    t = tables(spark, [], labels=(), pairs=())
    assert pruning.pruning_plan(*t, RULES).count() == 0
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert records(without(df, "k", ["a"])) == records(without(df, "k", df.where("k = 'a'"))) == [("b",), (None,)]
    assert records(without(df, "k", [])) == records(df)
