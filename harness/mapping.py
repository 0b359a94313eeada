"""Logical tables derived from the given star-schema tables (FIXTURES.md, part 3).

Only the tables that a logical table takes columns from are joined. All foreign
keys of the given tables are complete (a test checks it), so a join that adds
no column would change nothing. Each table is set up once per session.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spendscope import names as n, schemas as s

c = F.col


# Columns of the given tables; declaring them spares a job per read.
_GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


#: First and last day that a shipping date can be mapped to.
CALENDAR = ("2023-01-01", "2024-02-29")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def _whole(value: Column) -> Column:
    return F.floor(value).cast("double")


def _with_day(lineitem: DataFrame) -> DataFrame:
    shipped = F.datediff(c("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    return lineitem.withColumn("Date", F.date_add(F.lit("2023-01-01").cast("date"), shipped % 425))


def _generation_text(key: Column) -> Column:
    kind = key % 4
    return F.when(kind == 0, "2023-Q1").when(kind == 1, "2022").when(kind == 3, "clearance")


def _marks() -> dict[str, Column]:
    """What ads rows ask of a line's flags and supplier; a missing value is none of them."""
    return {
        "returned": c("l_returnflag") == "R", "accepted": c("l_returnflag") == "A", "finished": c("l_linestatus") == "F",
        "open": c("l_linestatus") == "O", "named": c("l_suppkey") % 17 != 0, "numbered": c("l_linenumber").isNotNull(),
    }


def _noted() -> Column:
    """The line number and a bit per mark in one number, which shuffles in fewer bytes than what they are read from."""
    marks = _marks().values()
    bits = sum((F.when(mark, 1 << bit).otherwise(0) for bit, mark in enumerate(marks)), F.lit(0))
    return F.shiftleft(F.coalesce(c("l_linenumber"), F.lit(0)).cast("long"), len(marks)) + bits


def _marked(name: str) -> Column:
    return c("noted").bitwiseAND(1 << list(_marks()).index(name)) != 0


def _line_number() -> Column:
    return F.when(_marked("numbered"), F.shiftright(c("noted"), len(_marks())))


def _ads_sku() -> Column:
    return F.concat(
        F.when(_line_number() == 7, " ").otherwise(""),
        F.lit("sku-"),
        c("l_partkey").cast("string"),
        F.when(_marked("returned"), "-hm").otherwise(""),
        F.when(_marked("finished"), "-xx").otherwise(""),
        F.when(_marked("open") & (_line_number() == 6), "\n").otherwise(""),
    )


def _merchant() -> Column:
    return F.when(_marked("finished"), n.SUFFIXED_MERCHANT).otherwise(n.MAIN_MERCHANT).cast("long")


def _currency() -> Column:
    return F.when(_marked("accepted"), "HKD").otherwise("USD")


def _country() -> Column:
    return F.when(_marked("named"), c("n_name"))


def _ads_measures(names: tuple[str, ...]) -> list[Column]:
    """Impressions, cost, clicks, conversions and value under the given names."""
    values = (
        c("l_quantity") * 100,
        c("cost_floor"),
        F.when(_line_number() == 1, 0.0).otherwise(c("l_quantity")),
        _line_number().cast("double"),
        c("value_floor"),
    )
    return [value.alias(name) for name, value in zip(names, values)]


def _ads_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as ads rows need them, with their supplier's nation and their part.

    Money is rounded down here: whole numbers shuffle in fewer bytes than prices do. Suppliers are joined first, and as
    stored: their size is then known while the join is planned, so that suppliers which can be broadcast cost no shuffle
    of the lines. The size of a join, as that of suppliers with their nations, is known only afterwards.
    """
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")
    price, discount = c("l_extendedprice"), c("l_discount")
    lines = _with_day(_table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", _noted().alias("noted"), "Date",
        _whole(price * discount / 10).alias("cost_floor"), _whole(price / 10).alias("value_floor"),
    )
    return lines.join(supplier, c("l_suppkey") == c("s_suppkey")).join(part, c("l_partkey") == c("p_partkey"))


def _with_nations(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the name of their supplier's nation; it comes last, as it is wide beside a key."""
    # 25 nations by definition, whatever the scale
    nation = F.broadcast(_table(spark, sf_dir, "nation"))
    return lines.join(nation, c("s_nationkey") == c("n_nationkey"))


@cache
def ads_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads_sku_daily(spark, sf_dir).select(*[f"`{f}`" for f in s.ADS_DAILY.fieldNames()])


@cache
def ads_sku_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads rows of the SKU page; rows may lack country and up to two labels."""
    return _with_nations(_ads_lines(spark, sf_dir), spark, sf_dir).select(
        _ads_sku().alias("SKU"), _currency().alias("Currency"), c("p_brand").alias(n.PT1),
        F.concat(F.lit("S"), (c("p_size") % 5).cast("string")).alias(n.PT2), c("p_type").alias(n.PT3),
        _country().alias("Country"), _generation_text(c("l_partkey")).alias("customlabel1"),
        F.concat(F.lit("L"), (_line_number() % 3).cast("string")).alias("customlabel2"),
        F.when(_line_number() % 4 != 0, F.concat(F.lit("M"), (c("l_partkey") % 5).cast("string")))
        .alias("customlabel4"),
        _merchant().alias("MC ID"), "Date", *_ads_measures(n.ADS_MEASURES),
    )


@cache
def ads_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ads_daily(spark, sf_dir)
        .withColumn("Month", F.trunc("Date", "month"))
        .select(*[f"`{f}`" for f in s.ADS_MONTHLY.fieldNames()])
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return orders.join(customer, c("o_custkey") == c("c_custkey")).select(
        "o_orderkey", "o_custkey", F.concat_ws("_", "o_orderpriority", "c_mktsegment").alias("Campaign"),
    )


def _with_orders(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their campaign. Its ID follows the join, so that ads and sensor rows ask for the same orders and one shuffle serves both."""
    joined = lines.join(_orders(spark, sf_dir), c("l_orderkey") == c("o_orderkey"))
    return joined.withColumn("Campaign ID", c("o_custkey") % 50)


@cache
def ads_campaign_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    # campaigns come after parts: lines that are shuffled for their part have no texts yet
    lines = _with_orders(_ads_lines(spark, sf_dir), spark, sf_dir)
    return _with_nations(lines, spark, sf_dir).select(
        "Campaign", _ads_sku().alias("SKU"), _currency().alias("currency"), c("p_type").alias(n.PT3),
        _country().alias("Country"), "Campaign ID", _merchant().alias("MC ID"), "Date",
        *_ads_measures(n.CAMPAIGN_ADS_MEASURES),
    )


def _sensor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sensor rows need them, GMV as a whole number that shuffles in fewer bytes than prices do."""
    return _with_day(_table(spark, sf_dir, "lineitem")).where(c("l_suppkey") % 5 != 0).select(
        "l_orderkey", "l_partkey", "Date", "l_quantity", "l_linenumber",
        _whole(c("l_extendedprice") * (1 - c("l_discount"))).alias("line_gmv"),
    )


def _sensor_sku() -> Column:
    return F.concat(F.lit("SKU-"), c("l_partkey").cast("string"))


def _sensor_sums(sale: str) -> list[Column]:
    visits = F.when(c("l_linenumber") <= 2, 0.0).otherwise(c("l_quantity") * 3)
    return [
        F.sum("l_quantity").alias(sale),
        F.sum("line_gmv").alias("GMV"),
        F.sum("l_linenumber").cast("double").alias("AddtoCart"),
        F.sum(visits).alias("UV"),
    ]


@cache
def sensor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sensor_lines(spark, sf_dir).groupBy(_sensor_sku().alias("SKU"), "Date").agg(*_sensor_sums("Sale"))


@cache
def sensor_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sensor_lines(spark, sf_dir).withColumn("Month", F.trunc("Date", "month"))
    return rows.groupBy(_sensor_sku().alias("SKU"), "Month").agg(*_sensor_sums("Sale"))


@cache
def sensor_campaign_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_orders(_sensor_lines(spark, sf_dir), spark, sf_dir)
    # dealt by the group once: else the distinct buyers need a shuffle of their own before that of the groups;
    # by the SKU's expression, so that its text is not shuffled beside the part that it is made of
    dealt = rows.repartition("Campaign", "Campaign ID", _sensor_sku(), "Date").withColumn("SKU", _sensor_sku())
    return dealt.groupBy("Campaign", "Campaign ID", "SKU", "Date").agg(
        F.countDistinct("o_custkey").cast("double").alias("saleuser"), *_sensor_sums("sale")
    )


@cache
def spu_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPU index with odd blanks in every third SKU and a second SPU for some.

    One pass over the parts gives both entries.
    """
    key = c("p_partkey").cast("string")
    regular = F.when(
        c("p_partkey") % 11 != 0,
        F.struct(
            F.when(c("p_partkey") % 3 == 0, F.concat(F.lit(" sku-"), key, F.lit("\n")))
            .otherwise(F.concat(F.lit("SKU-"), key)).alias("SKU"),
            F.concat(F.lit("SPU-"), (c("p_partkey") % 200).cast("string")).alias("SPU"),
        ),
    )
    second = F.when(
        c("p_partkey") % 97 == 0,
        F.struct(F.concat(F.lit("SKU-"), key).alias("SKU"), F.lit("SPU-DUP").alias("SPU")),
    )
    return _table(spark, sf_dir, "part").select(F.inline(F.array_compact(F.array(regular, second))))


@cache
def product_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = c("p_partkey")
    return _table(spark, sf_dir, "part").where(key % 19 != 0).select(
        F.concat(F.lit("SKU-"), key.cast("string")).alias("SKU"),
        _generation_text(key).alias("customlabel1"),
        F.concat(F.lit("https://img/"), key.cast("string")).alias("imagelink"),
        F.when(key % 13 != 0, c("p_retailprice")).alias(n.PRICE),
    )


@cache
def spu_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows; every eleventh has no SPU yet."""
    key = c("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.when(key % 11 != 0, F.concat(F.lit("SPU-"), (key % 200).cast("string"))).alias("SPU"),
        F.concat(F.lit("https://img/"), key.cast("string")).alias(n.IMAGE),
    )
