from datetime import date

import pytest
from pyspark.sql import functions as F

from data import DAY, ads, records, sensor
from harness import mapping
from spendscope import names as n
from spendscope.operators import rollup
from spendscope.sources import keys, tables as t


def test_csv_export_in_any_column_order(spark, tmp_path):
    path = tmp_path / "sensor.csv"
    path.write_text("UV,extra,日期,SKU,GMV,加购,销量\n10,x,2023-06-01,A,5.5,2,3\n,x,2023-06-02,B,,,\n", encoding="utf-8")
    df = t.read_table(spark, t.SENSOR_DAILY, str(path), "csv")
    assert df.schema == t.SENSOR_DAILY.schema
    assert records(df, "SKU", "Date", "Sale", "GMV", "AddtoCart", "UV") == [
        ("A", DAY, 3.0, 5.5, 2.0, 10.0), ("B", date(2023, 6, 2), None, None, None, None)]


def test_csv_cells_may_hold_line_feeds(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text('SKU,SPU\n"a\nb",s\n', encoding="utf-8")
    assert records(t.read_table(spark, t.SPU_INDEX, str(path), "csv", line_feeds=True)) == [("a\nb", "s")]
    assert records(t.read_sheet(spark, str(path), "csv", line_feeds=True)) == [("a\nb", "s")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_not_a_number_is_missing(spark, tmp_path, fmt):
    path = str(tmp_path / "ads")
    t.write_result(ads(spark, {"cost": float("nan"), "click": 0.0}, {"cost": 2.0}, {"SKU": "B", "cost": float("nan")}), path, fmt)
    df = t.read_table(spark, t.ADS_DAILY, path, fmt)
    sums = rollup.group_sum(df, ["SKU"], n.ADS_MEASURES)
    assert records(sums, "SKU", "cost", "click") == [("A", 2.0, 5.0), ("B", 0.0, 5.0)]
    assert records(rollup.grand_total(df, ["cost"])) == [(2.0,)]
    shown = rollup.grand_total(df.where("cost is null and click = 0"), n.ADS_MEASURES)
    from spendscope.functions.ratios import protected_ratio, raw_ratio

    assert records(shown.select(protected_ratio(F.col("ads value"), F.col("cost")), raw_ratio(F.col("cost"), F.col("click")))) == [(0.0, None)]
    sheet = t.read_sheet(spark, path, fmt)
    if fmt == "parquet":
        assert sorted(r[0] or 0.0 for r in sheet.select("cost").collect()) == [0.0, 0.0, 2.0]


def test_malformed_dates_fail(spark, tmp_path):
    path = tmp_path / "sensor.csv"
    path.write_text("日期,SKU,GMV,加购,销量,UV\nsoon,A,1,1,1,1\n", encoding="utf-8")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        t.read_table(spark, t.SENSOR_DAILY, str(path), "csv").collect()


def test_parquet_round_trip_with_sheet_headers(spark, tmp_path):
    path = str(tmp_path / "sensor")
    facts = sensor(spark, {}, {"SKU": "B", "Date": date(2023, 7, 1)})
    t.write_result(facts.withColumnRenamed("Date", "日期"), path)
    df = t.read_table(spark, t.SENSOR_DAILY, path)
    assert records(df) == records(facts.select(df.columns))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        t.write_result(facts, path)


def test_partitioned_and_csv_sinks(spark, tmp_path):
    facts = ads(spark, {}, {"SKU": "B"})
    t.write_result(facts, str(tmp_path / "by_sku"), partition_by=["SKU"])
    assert {p.name for p in (tmp_path / "by_sku").iterdir() if p.is_dir()} == {"SKU=A", "SKU=B"}
    assert t.read_table(spark, t.ADS_DAILY, str(tmp_path / "by_sku")).count() == 2
    t.write_result(facts, str(tmp_path / "csv"), "csv")
    assert records(t.read_table(spark, t.ADS_DAILY, str(tmp_path / "csv"), "csv")) == records(facts)


def test_key_lists(spark, tmp_path):
    typed = keys.keys_from_text(spark, "A\nB\n", "SKU")
    assert records(typed) == [("",), ("A",), ("B",)]
    assert records(keys.keys_from_text(spark, "", "SKU")) == [("",)]
    path = tmp_path / "keys.txt"
    path.write_text("B\nC\n")
    stored = keys.keys_from_file(spark, str(path), "key")
    facts = ads(spark, {}, {"SKU": "B"}, {"SKU": None})
    assert records(keys.restrict(facts, "SKU", stored), "SKU") == [("B",)]
    assert records(keys.restrict(facts, "SKU", typed), "SKU") == [("A",), ("B",)]
    assert records(keys.restrict(facts, "SKU", ["A"]), "SKU") == [("A",)]


def test_small_aggregates(spark):
    facts = ads(spark, {"cost": 3.0}, {"cost": 7.0, "Date": date(2023, 6, 9)}, {"cost": None})
    assert records(rollup.extremes(facts, "Date")) == [(DAY, date(2023, 6, 9))]
    assert records(rollup.column_maxima(facts, ["cost", "ads value"])) == [(7.0, 20.0)]
    assert records(rollup.distinct_values(facts, "SKU")) == [("A",)]
    assert records(rollup.grand_total(facts.where("false"), ["cost"])) == [(0.0,)]
    assert rollup.to_front(facts, "cost").columns[0] == "cost"
    assert "费用" in rollup.relabel(facts, n.REPORT_LABELS).columns


def test_noted_lines_give_line_numbers_and_flags_back(spark):
    lines = [(number, flag, status, supplier) for number in (None, -3, 0, 1, 6, 7, 2**31 - 1) for flag in (None, "R", "A", "N")
             for status in (None, "F", "O") for supplier in (None, 17, 18)]
    given = spark.createDataFrame(lines, "l_linenumber int, l_returnflag string, l_linestatus string, l_suppkey bigint")
    got = given.withColumn("noted", mapping._noted()).select(
        mapping._line_number().alias("number"), *[mapping._marked(m).alias(m) for m in mapping._marks()],
        mapping._merchant().alias("merchant"), mapping._currency().alias("currency")).collect()
    for (number, flag, status, supplier), row in zip(lines, got, strict=True):
        assert tuple(row) == (number, flag == "R", flag == "A", status == "F", status == "O", supplier == 18, number is not None,
                              n.SUFFIXED_MERCHANT if status == "F" else n.MAIN_MERCHANT, "HKD" if flag == "A" else "USD")


def test_columns_go_to_either_end(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "a int, `b c` int, d int, e int")
    assert rollup.to_ends(rows, ["d", "none"], ["a"]).columns == ["d", "b c", "e", "a"]
    assert records(rollup.to_ends(rows, ["d"], ["a"])) == [(3, 2, 4, 1)]
