"""Physical plans: what is pushed down, pruned, shuffled and never used."""

import contextlib
import io
import re
from datetime import date

import pytest

from data import ads, ads_campaign, ads_sku, index, label, sensor, sensor_campaign
from harness.registry import REPORTS
from spendscope.plans import campaign, sku, spu
from spendscope.sources import tables as t

SF = "/root/testdata/sf0.001"
WEEK = ("2023-06-01", "2023-06-07")


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables read from Parquet, as on a cluster."""
    root = tmp_path_factory.mktemp("tables")

    def keep(name, df, table):
        t.write_result(df, str(root / name))
        return t.read_table(spark, table, str(root / name))

    return {
        "ads": keep("ads", ads(spark, {}), t.ADS_DAILY),
        "ads_sku": keep("ads_sku", ads_sku(spark, {}), t.ADS_SKU_DAILY),
        "ads_campaign": keep("ads_campaign", ads_campaign(spark, {}), t.ADS_CAMPAIGN_DAILY),
        "sensor": keep("sensor", sensor(spark, {}), t.SENSOR_DAILY),
        "sensor_campaign": keep("sensor_campaign", sensor_campaign(spark, {}), t.SENSOR_CAMPAIGN_DAILY),
        "index": keep("index", index(spark, ("A", "s")), t.SPU_INDEX),
        "label": keep("label", label(spark, {}), t.PRODUCT_LABEL),
    }


def scans(text):
    return re.findall(r"Scan parquet \nOutput.*?(?=\n\n)", text, re.S)


def test_trend_pushes_dates_and_prunes_columns(stored):
    text = plan(spu.spu_trend(stored["ads"], stored["sensor"], stored["index"], stored["label"], *WEEK))
    facts = [s for s in scans(text) if "Date:date" in s]
    assert len(facts) == 2
    for scan in facts:
        assert "GreaterThanOrEqual(Date,2023-06-01)" in scan and "LessThanOrEqual(Date,2023-06-07)" in scan
    label_scan = [s for s in scans(text) if "/label" in s]
    assert len(label_scan) == 1 and "ReadSchema: struct<SKU:string>" in label_scan[0]
    assert all("conversions" not in s for s in scans(text))


def test_outer_join_with_the_index_becomes_inner(stored):
    text = plan(spu.spu_trend(stored["ads"], stored["sensor"], stored["index"], stored["label"], *WEEK))
    tree = text.split("\n\n\n")[0]
    assert len(re.findall(r"Join Inner|JoinExec Inner|HashJoin Inner|MergeJoin Inner", tree)) == 1
    assert len(re.findall(r"LeftOuter", tree)) == 2 and "FullOuter" not in tree


def test_sku_list_reaches_both_fact_scans(stored):
    text = plan(sku.period_summary(stored["ads_sku"], stored["sensor_campaign"], stored["index"], *WEEK, skus=["A"]))
    sensor_scan = [s for s in scans(text) if "/sensor_campaign" in s][0]
    assert "EqualTo(SKU,A)" in sensor_scan or "In(SKU, [A])" in sensor_scan
    ads_filter = [b for b in text.split("\n\n") if "Filter" in b and "regexp_replace" in b]
    assert ads_filter, "the normalised SKU is tested on the ads scan, before any shuffle"


def test_one_pass_serves_both_periods(stored):
    tables = stored["ads_sku"], stored["sensor_campaign"], stored["index"]
    text = plan(sku.compare_periods(*tables, WEEK, ("2023-06-08", "2023-06-14")))
    assert len([s for s in scans(text) if "/ads_sku" in s]) == 1
    assert len([s for s in scans(text) if "/sensor_campaign" in s]) == 1


def test_campaign_list_needs_one_narrow_scan(stored):
    text = plan(campaign.campaigns_in_range(stored["ads_campaign"], *WEEK))
    assert len(scans(text)) == 1 and "Join" not in text.split("\n\n")[0]
    assert "Impression" not in scans(text)[0]


@pytest.mark.parametrize("name", [
    "q2_enriched_daily", "q4_enriched_campaign", "q5_month_history", "q9_spu_trend", "q10_spu_skus",
    "q11_spu_cost_matrix", "q12_yearly_summary", "q13_sku_period_skus", "q14_compare_periods", "q15_sku_cost_matrix",
    "q16_campaign_series", "q18_custom_labels",
])
def test_large_tables_never_meet_in_one_task_or_in_python(spark, name):
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(REPORTS[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval", text)
    # windows run over product tables or per-day counts only, never over facts
    for window in re.findall(r"\) Window\n.*?(?=\n\n)", text, re.S):
        assert re.search(r"_copies|spu_rows|label_rows", window), window


def final_plan(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def low_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, make, **more):
    """Half of the rows in one SKU, over many countries."""
    rows = [{"SKU": "HOT" if i % 2 else f"S{i}", "Country": f"c{i}", "Date": date(2023, 6, 1 + i % 7), **{k: f"{v}{i}" for k, v in more.items()}} for i in range(3000)]
    return make(spark, *rows)


def test_hot_sku_of_the_full_rows_is_split(spark, low_thresholds):
    tables = hot(spark, ads), sensor(spark, {"SKU": "HOT"}), index(spark, *[(f"S{i}", "s") for i in range(200)], ("HOT", "s")), label(spark, {})
    assert "skew=true" in final_plan(spu.enriched_rows(*tables))


def test_hot_sku_of_the_campaign_rows_is_split(spark, low_thresholds):
    tables = hot(spark, ads_campaign, Campaign="c"), sensor_campaign(spark, {"SKU": "HOT"}), index(spark, *[(f"S{i}", "s") for i in range(200)], ("HOT", "s")), label(spark, {})
    assert "skew=true" in final_plan(campaign.enriched_rows(*tables))


def test_folded_sku_has_a_row_per_day_and_category_before_it_meets_products(spark):
    tables = hot(spark, ads), sensor(spark, {"SKU": "HOT"}), index(spark, ("HOT", "s")), label(spark, {})
    assert spu.folded_rows(*tables).where("SKU = 'HOT'").count() == 7


def test_series_scan_the_ads_once(stored):
    tables = stored["ads_campaign"], stored["sensor_campaign"], stored["index"], stored["label"]
    text = final_plan(campaign.campaign_day_series(*tables, *WEEK))
    assert len(re.findall(r"FileScan parquet.*ads_campaign", text)) == 1 and "ReusedExchange" in text
    text = final_plan(campaign.campaign_series(*tables, *WEEK))
    assert len(re.findall(r"FileScan parquet.*ads_campaign", text)) == 1 and "Window" not in text


@pytest.mark.parametrize("build", [
    lambda t: spu.spu_skus(t["ads"], t["sensor"], t["index"], t["label"], ["s"], *WEEK), lambda t: spu.day_detail(t["ads"], t["sensor"], t["index"], t["label"], t["index"].select("SPU")),
    lambda t: campaign.campaign_series(t["ads_campaign"], t["sensor_campaign"], t["index"], t["label"], *WEEK),
])
def test_no_job_runs_while_a_report_is_planned(spark, stored, build):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    build(stored)
    jobs = tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
    assert not jobs


def test_two_tables_of_visits_and_products_meet_ads_once(stored):
    text = plan(spu.enriched_rows(stored["ads"], stored["sensor"], stored["index"], stored["label"]))
    assert len([s for s in scans(text) if "/label" in s]) == 1 and len([s for s in scans(text) if "/index" in s]) == 1


def exchanges(spark, df):
    """(columns, partitioning) of every shuffle, without broadcasts."""
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    return re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: (.*)", text)


def test_campaign_facts_are_shuffled_twice_only(spark, stored):
    """Once to merge and meet sensor rows, once to meet products, which sums by product then follow."""
    tables = stored["ads_campaign"], stored["sensor_campaign"], stored["index"], stored["label"]
    for df in (campaign.enriched_rows(*tables), campaign.campaign_points(*tables, *WEEK)):
        assert len([x for x, _ in exchanges(spark, df) if "Impression" in x]) == 2


def test_distinct_buyers_need_no_shuffle_of_their_own(spark):
    rows = REPORTS["a3_sensor_campaign_daily"](spark, SF)
    assert not [by for _, by in exchanges(spark, rows) if "SKU" in by and "o_custkey" in by]


def test_partitions_grow_with_the_stored_facts(spark, monkeypatch):
    from harness.registry import QUERIES
    from spendscope import session

    key, file_size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"
    kept = {k: spark.conf.get(k, None) for k in (key, *session.TASK_SIZES)}
    try:
        spark.conf.set(file_size, "7MB")
        QUERIES["f4_ctr"](spark, SF)
        assert spark.conf.get(key) == "4" and spark.conf.get(file_size) == "7MB"
        monkeypatch.setattr(session, "STORED_BYTES_A_PARTITION", 4096)
        rows = QUERIES["f4_ctr"](spark, SF)
        assert int(spark.conf.get(key)) > 20
        assert f", {spark.conf.get(key)})" in " ".join(by for _, by in exchanges(spark, rows))
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def columns_of(shuffled):
    return re.sub(r"#\d+L?", "", shuffled).strip("[]").split(", ")


def test_suppliers_that_can_be_broadcast_cost_no_shuffle_of_the_lines(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    previous = spark.conf.get(key)
    spark.conf.set(key, "20000")  # more than the suppliers hold, less than Spark expects of their join with nations
    try:
        text = plan(REPORTS["a1_ads_campaign_daily"](spark, SF))
    finally:
        spark.conf.set(key, previous)
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(l_suppkey" not in text and "s_suppkey" in text


def test_orders_are_shuffled_once_for_ads_and_sensor_rows(spark, low_thresholds):
    text = final_plan(REPORTS["q4_enriched_campaign"](spark, SF))
    assert len(re.findall(r"\+- Exchange hashpartitioning\(o_orderkey", text)) == 1


def test_campaign_facts_are_shuffled_without_what_follows_from_them(spark):
    names = [set(columns_of(x)) for x, _ in exchanges(spark, REPORTS["q4_enriched_campaign_sorted"](spark, SF))]
    assert any({"l_orderkey", "noted"} <= x for x in names) and any({"line_gmv", "o_custkey"} <= x for x in names)
    assert not any({"l_returnflag", "l_linestatus", "normalised", "line_visits"} & x for x in names)
    assert not any({"line_gmv", "SKU"} <= x or {"o_orderkey", "Campaign ID"} <= x for x in names)


def test_sorted_rows_are_shuffled_with_what_their_sku_has_alike_in_front(spark):
    rows = REPORTS["q4_enriched_campaign_sorted"](spark, SF)
    columns = [x for x, by in exchanges(spark, rows) if "rangepartitioning" in by]
    assert len(columns) == 1
    shown = columns_of(columns[0])
    assert shown[:6] == ["SKU", "Product Type 3", "SPU", "old_or_new", "Sale Price", "image"] and shown[-1] == "Campaign"
    assert rows.columns == REPORTS["q4_enriched_campaign"](spark, SF).columns
