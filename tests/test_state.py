import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from data import ads, records
from spendscope.operators import cleaning
from spendscope.sources import checked, state, statistics, tables as t
from spendscope.sources.scratch import shared_folder

DAILY = cleaning.DAILY


def rows_of(spark, count, seed):
    rnd = random.Random(seed)
    return ads(spark, *[{"SKU": rnd.choice(["A", "B-hm", "abc"]), "MC ID": rnd.choice([569301767, 1]), "Country": rnd.choice(["US", None, "CA"]), "Currency": rnd.choice(["HKD", "USD"]),
                         "Date": date(2023, rnd.randint(1, 4), rnd.randint(1, 3)), "cost": float(rnd.randint(0, 9)), "click": rnd.choice([None, 1.0])} for _ in range(count)])


def full_run(df):
    return cleaning.merge_repeats(cleaning.repair_rows(df, DAILY), DAILY)


def same(left, right):
    shown = lambda df: records(df.select(*DAILY.keys, *[F.round(f"`{m}`", 6).alias(m) for m in DAILY.measures]))
    assert shown(left) == shown(right)


def test_three_deliveries_equal_a_full_run(spark, tmp_path):
    path = str(tmp_path / "state")
    parts = [rows_of(spark, 60, i) for i in range(3)]
    for number, part in enumerate(parts, 1):
        state.refresh(spark, path, state.delivery(part), DAILY, number)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    same(state.current(spark, path, DAILY), full_run(whole))
    assert records(state.cleaned(spark, path, DAILY).select("SKU", "Date").distinct()) == records(cleaning.clean_ads(whole, DAILY).select("SKU", "Date").distinct())


def test_corrected_and_taken_back_rows(spark, tmp_path):
    path = str(tmp_path / "state")
    kept, wrong, right = rows_of(spark, 30, 1), rows_of(spark, 20, 2), rows_of(spark, 20, 3)
    state.refresh(spark, path, state.delivery(kept.unionByName(wrong)), DAILY, 1)
    state.refresh(spark, path, state.delivery(right, wrong), DAILY, 2)
    same(state.current(spark, path, DAILY), full_run(kept.unionByName(right)))
    state.refresh(spark, path, state.delivery(right.limit(0), kept.unionByName(right)), DAILY, 3)
    assert state.current(spark, path, DAILY).count() == 0
    state.refresh(spark, path, state.delivery(kept), DAILY, 4)
    same(state.current(spark, path, DAILY), full_run(kept))


def test_only_touched_months_are_written_and_late_rows_touch_old_ones(spark, tmp_path):
    path = tmp_path / "state"
    state.refresh(spark, str(path), state.delivery(ads(spark, *[{"Date": date(2023, i, 1)} for i in range(1, 6)])), DAILY, 1)
    files = lambda: {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in path.glob("month=*")}
    before = files()
    assert state.refresh(spark, str(path), state.delivery(ads(spark, {"Date": date(2023, 2, 9)}, {"Date": date(2023, 7, 1)})), DAILY, 2) == ["2023-02-01", "2023-07-01"]
    after = files()
    assert {k for k in after if after[k] != before.get(k)} == {"month=2023-02-01", "month=2023-07-01"}
    assert state.current(spark, str(path), DAILY).count() == 7


def test_a_repeated_delivery_changes_nothing_and_a_broken_one_is_completed(spark, tmp_path):
    path = str(tmp_path / "state")
    first, second = rows_of(spark, 40, 4), rows_of(spark, 40, 5)
    state.refresh(spark, path, state.delivery(first), DAILY, 1)
    half = second.where(F.month("Date") <= 2)
    state.refresh(spark, path, state.delivery(half), DAILY, 2)  # as if the rest had been lost on the way
    written = state.refresh(spark, path, state.delivery(second), DAILY, 2)
    assert all(m >= "2023-03-01" for m in written) and written
    assert state.refresh(spark, path, state.delivery(second), DAILY, 2) == []
    same(state.current(spark, path, DAILY), full_run(first.unionByName(second)))


def test_empty_deliveries(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state.refresh(spark, path, state.delivery(rows_of(spark, 3, 1).limit(0)), DAILY, 1) == []
    assert state.refresh(spark, path, state.delivery(rows_of(spark, 9, 1)), DAILY, 1)
    assert state.refresh(spark, path, state.delivery(rows_of(spark, 3, 1).limit(0)), DAILY, 2) == []


# -- rows set aside -----------------------------------------------------------

CSV = """日期,SKU,GMV,加购,销量,UV,extra
2023-06-01,A,5.5,2,3,10,x
soon,B,1,1,1,1,
2023-06-02,C,one,1,NaN,1,
2023-06-03,,1, ,1,1,
never,,x,1,1,1,
2023-06-04,D,,,,
"""


def test_good_rows_and_rejects_add_up(spark, tmp_path):
    path = tmp_path / "sensor.csv"
    path.write_text(CSV, encoding="utf-8")
    found = checked.read_checked(spark, t.SENSOR_DAILY, str(path), "csv", required=("SKU",))
    assert found.good.schema == t.SENSOR_DAILY.schema
    assert records(found.good.select("SKU", "GMV", "UV")) == [("A", 5.5, 10.0), ("D", None, None)]
    assert records(found.rejects.select("file", "reason")) == [
        ("sensor.csv", "Date is no date"), ("sensor.csv", "Date is no date; GMV is no double; SKU is missing"),
        ("sensor.csv", "GMV is no double"), ("sensor.csv", "SKU is missing")]
    assert found.good.count() + found.rejects.count() == 6
    raw = {r["raw"]["SKU"]: r["raw"] for r in found.rejects.collect() if r["raw"]["SKU"]}
    assert raw["B"]["Date"] == "soon" and raw["C"]["GMV"] == "one" and raw["C"]["Sale"] == "NaN"
    counts = {r["reason"]: r["rows"] for r in checked.reject_counts(found).collect()}
    assert counts == {None: 2, "Date is no date": 2, "GMV is no double": 2, "SKU is missing": 2}


def test_the_strict_reader_agrees_on_good_files(spark, tmp_path):
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        t.write_result(ads(spark, {}, {"SKU": " a b ", "cost": float("nan"), "Country": None}), path, fmt)
        found = checked.read_checked(spark, t.ADS_DAILY, path, fmt)
        assert records(found.good) == records(t.read_table(spark, t.ADS_DAILY, path, fmt)) and found.rejects.count() == 0
        assert " a b " in {r["SKU"] for r in found.good.collect()}


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("SKU\nA\n", encoding="utf-8")
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        checked.read_checked(spark, t.SPU_INDEX, str(path), "csv")


def test_parquet_of_other_types(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("A", "2023-06-01", "1.5"), ("B", "x", None)], "SKU string, Date string, GMV string").selectExpr("*", "1L Sale", "2 AddtoCart", "3.0 UV").write.parquet(path)
    found = checked.read_checked(spark, t.SENSOR_DAILY, path)
    assert records(found.good.select("SKU", "GMV", "Sale")) == [("A", 1.5, 1.0)] and records(found.rejects.select("reason")) == [("Date is no date",)]


# -- bounds from footers ------------------------------------------------------


def test_bounds_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "ads")
    t.write_result(rows_of(spark, 50, 6).repartition(3), path)
    bounds = statistics.footer_bounds(spark, path, "Date", "cost")
    text = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(Date), MAX(Date), MIN(cost), MAX(cost)]" in text
    want = spark.read.parquet(path).agg(F.min("Date"), F.max("Date"), F.min("cost"), F.max("cost")).first()
    assert tuple(bounds.first()) == tuple(want)
    assert statistics.stored_range(spark, path) == (want[0], want[1])
    assert statistics.stored_bounds(spark, path, ["cost"]) == {"cost": (want[2], want[3])}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_bounds_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    t.write_result(rows_of(spark, 1, 1).limit(0), path)
    assert statistics.stored_range(spark, path) is None


def test_shared_folder_is_below_the_checkpoint_folder(spark):
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0]
