import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from data import DAY, ads, index, label, records, sensor
from spendscope.operators import range_sums as r
from spendscope.plans import spu


def day(i):
    return DAY + timedelta(days=i)


def facts(spark, rows):
    return spark.createDataFrame(rows, "k string, Date date, x double, `y z` double")


def ranges(spark, *rows, key=True):
    return spark.createDataFrame(rows, ("k string, " if key else "") + "first date, last date")


def rows_of(seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *map(day, (0, 1, 4, 5, 9))]), float(rnd.randint(-9, 9)), rnd.choice([None, 1.0, 2.5])) for _ in range(80)]


def by_hand(rows, asked):
    out = {}
    for k, first, last in asked:
        sums = out.setdefault((first, last), [0.0, 0.0])
        for key, d, x, y in rows:
            if d is not None and key == k and first <= d <= last:
                sums[0] += x
                sums[1] += y or 0.0
    return out


def test_ranges_equal_direct_sums(spark):
    rows = rows_of()
    asked = [(k, day(i), day(j)) for k in ("a", "b", "none") for i in range(-3, 13) for j in (i, i + 1, i + 5, i + 40)]
    totals = r.running_totals(facts(spark, rows), ["k"], ["x", "y z"])
    got = r.range_sums(totals, ranges(spark, *asked))
    assert {(x["first"], x["last"]): [x["x"], x["y z"]] for x in got.collect()} == by_hand(rows, asked)
    by_key = r.range_sums(totals, ranges(spark, *asked), ("k", "first", "last"))
    assert {(x["k"], x["first"], x["last"]): x["x"] for x in by_key.collect()} == {(k, a, b): by_hand(rows, [(k, a, b)])[a, b][0] for k, a, b in asked}


def test_whole_table_ranges(spark):
    rows = [(k or "a", d, x, y) for k, d, x, y in rows_of(2)]
    totals = r.running_totals(facts(spark, rows), [], ["x"])
    asked = [(day(0), day(4)), (day(2), day(3)), (day(-9), day(99))]
    got = {(x["first"], x["last"]): x["x"] for x in r.range_sums(totals, ranges(spark, *asked, key=False)).collect()}
    assert got == {(a, b): sum(x for _, d, x, _ in rows if d and a <= d <= b) for a, b in asked}


def test_odd_ranges_and_empty_tables(spark):
    totals = r.running_totals(facts(spark, [("a", day(0), 1.0, 1.0)]), ["k"], ["x"])
    got = r.range_sums(totals, ranges(spark, ("a", day(3), day(1)), ("a", None, day(1)), ("a", day(0), day(0)), ("a", day(0), day(0))))
    assert records(got) == [(day(0), day(0), 2.0), (day(3), day(1), 0.0)]  # rows alike add up
    none = r.running_totals(facts(spark, []), ["k"], ["x"])
    assert records(r.range_sums(none, ranges(spark, ("a", day(0), day(1))))) == [(day(0), day(1), 0.0)]
    assert r.range_sums(totals, ranges(spark)).count() == 0


def test_windows_see_days_and_not_facts(spark):
    totals = r.running_totals(facts(spark, rows_of()), ["k"], ["x"])
    text = totals.rows._jdf.queryExecution().executedPlan().toString()
    window = text.index("Window [")
    assert "HashAggregate" in text[window:]  # daily sums below the window
    assert not re.search("Cartesian", text)


def test_stored_totals_answer_alike(spark, tmp_path):
    totals = r.running_totals(facts(spark, rows_of()), ["k"], ["x", "y z"])
    totals.rows.write.parquet(str(tmp_path / "t"))
    stored = r.RunningTotals(spark.read.parquet(str(tmp_path / "t")), totals.keys, totals.measures)
    asked = ranges(spark, ("a", day(1), day(5)), ("b", day(0), day(9)))
    assert records(r.range_sums(stored, asked)) == records(r.range_sums(totals, asked))


@pytest.fixture
def tables(spark):
    rows = [{"SKU": x, "Date": day(i), "cost": float(i + 1), "Country": c} for x in "AB" for i in (0, 1, 4, 8) for c in ("US", "CA")]
    visits = [{"SKU": x, "Date": day(i), "GMV": float(10 * i)} for x in "AB" for i in (0, 4, 5)]
    return ads(spark, *rows), sensor(spark, *visits), index(spark, ("A", "s"), ("B", "t"), ("B", "s")), label(spark, {}, {"SKU": "B"})


def test_reports_of_many_ranges_equal_one_by_one(spark, tables):
    totals = spu.spu_running_totals(*tables)
    spans = [(day(i), day(j)) for i in (0, 1, 3) for j in (4, 8, 10)]
    asked = spark.createDataFrame([(s, a, b) for s in ("s", "t") for a, b in spans], "SPU string, first date, last date")
    sums, means = spu.totals_of_ranges(totals, asked), spu.means_of_ranges(totals, asked)
    for a, b in spans:
        one = F.col("first").eqNullSafe(F.lit(a)) & F.col("last").eqNullSafe(F.lit(b))
        assert records(sums.where(one).drop("first", "last")) == records(spu.range_total(*tables, ["s", "t"], a, b))
        assert records(means.where(one).drop("first", "last")) == records(spu.range_mean(*tables, ["s", "t"], a, b))


def test_changes_to_the_next_range(spark, tables):
    totals = spu.spu_running_totals(*tables)
    asked = spark.createDataFrame([("s", day(0), day(3)), ("s", day(9), day(9))], "SPU string, first date, last date")
    got = {x["first"]: x for x in spu.changes_of_ranges(totals, asked).collect()}
    base, after = (spu.range_total(*tables, ["s"], a, b).first() for a, b in ((day(0), day(3)), (day(4), day(7))))
    assert got[day(0)]["cost"] == pytest.approx((after["费用"] - base["费用"]) / base["费用"])
    assert got[day(9)]["cost"] is None  # nothing to compare with
