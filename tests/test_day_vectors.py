from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from data import DAY, ads, ads_sku, index, label, records, sensor
from spendscope.operators import day_vectors as v, matrix
from spendscope.plans import sku, spu


def table(spark, *rows):
    return spark.createDataFrame(rows, "k string, Date date, cost double")


def day(i):
    return DAY + timedelta(days=i)


ROWS = [("a", day(0), 1.0), ("a", day(0), 2.0), ("a", day(3), None), ("a", day(5), 0.0), ("b", day(2), 160.0), ("c", None, 5.0), ("d", day(9), 7.0), (None, day(1), 60.0)]


def test_vectors_hold_the_days_with_rows(spark):
    got = {r["k"]: r["days"] for r in v.day_vectors(table(spark, *ROWS), ["k"]).collect()}
    assert got == {"a": {day(0): 3.0, day(3): None, day(5): 0.0}, "b": {day(2): 160.0}, "d": {day(9): 7.0}, None: {day(1): 60.0}}
    assert v.day_vectors(table(spark), ["k"]).count() == 0


@pytest.mark.parametrize("first, last", [(0, 6), (1, 4), (3, 3), (-5, -1), (8, 20), (0, 400)])
def test_cells_of_any_range(spark, first, last):
    vectors = v.day_vectors(table(spark, *ROWS), ["k"])
    got = {r["k"]: r["c"] for r in vectors.select("k", v.cells(F.col("days"), day(first), day(last)).alias("c")).collect()}
    held = {r["k"]: r["days"] for r in vectors.collect()}
    assert got == {k: [days.get(day(i)) for i in range(first, last + 1)] for k, days in held.items()}


def test_columns_equal_a_pivot(spark):
    df = table(spark, *ROWS)
    days = v.days_between(day(0), day(6))
    chosen = df.where(F.col("Date").between(day(0), day(6)))
    pivot = chosen.withColumn("d", F.date_format("Date", "yyyy-MM-dd")).groupBy("k").pivot("d", days).agg(F.sum("cost"))
    got = matrix.day_matrix(df, ["k"], day(0), day(6))
    assert got.columns == pivot.columns and records(got) == records(pivot)


def test_lists_bands_and_long_form(spark):
    vectors = v.day_vectors(table(spark, *ROWS), ["k"])
    row = {r["k"]: r for r in v.listed(vectors, ["k"], bands=True).collect()}["a"]
    assert row["Date"] == [day(i).isoformat() for i in (0, 3, 5)] and row["cost"] == [3.0, None, 0.0] and row["band"] == ["low", "none", "none"]
    assert records(v.long_form(vectors, ["k"])) == records(
        table(spark, ("a", day(0), 3.0), ("a", day(3), None), ("a", day(5), 0.0), ("b", day(2), 160.0), ("d", day(9), 7.0), (None, day(1), 60.0)))


def test_the_plan_of_vectors_does_not_grow_with_the_range_and_no_job_plans_it(spark):
    tables = ads(spark, {}, {"Date": date(2030, 1, 1)}), sensor(spark), index(spark, ("A", "s")), label(spark, {})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("vectors", "vectors")
    whole = spu.spu_cost_vectors(*tables, ["s"])
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert not tracker.getJobIdsForGroup("vectors")
    spark.sparkContext.setJobGroup("", "")
    ranged = spu.spu_cost_vectors(*tables, ["s"], (DAY, date(2030, 1, 1)))
    assert len(ranged._jdf.queryExecution().executedPlan().toString()) < 1.3 * len(text)
    assert [r["days"] for r in whole.collect()] == [{DAY: 10.0, date(2030, 1, 1): 10.0}] == [r["days"] for r in ranged.collect()]


def test_matrices_are_views_over_vectors(spark):
    rows = [{"SKU": x, "Date": day(i), "cost": float(i * 7 + 1), "Country": c} for x in "AB" for i in (0, 1, 4) for c in ("US", "CA")]
    tables = ads(spark, *rows), sensor(spark), index(spark, ("A", "s"), ("B", "s"), ("B", "s")), label(spark, {}, {"SKU": "B"})
    vectors = spu.spu_cost_vectors(*tables, ["s"])
    assert records(v.day_columns(vectors, spu.MATRIX_ROWS, day(0), day(4))) == records(spu.spu_cost_matrix(*tables, ["s"], day(0), day(4), bands=False))
    sheet = ads_sku(spark, *rows)
    got = sku.sku_cost_vectors(sheet, tables[2], ["A", "B"])
    assert records(v.day_columns(got, ["SKU"], day(0), day(4))) == records(sku.sku_cost_matrix(sheet, tables[2], ["A", "B"], day(0), day(4)))
    assert {r["SKU"]: r["days"][day(1)] for r in got.collect()} == {"A": 16.0, "B": 32.0}
