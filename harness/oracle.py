"""SQL counterparts of the registered queries, for DuckDB on the given tables.

Written from the report rules as plain left joins and group-bys, independently
of how the engine plans them.
"""

from __future__ import annotations

from datetime import date, timedelta

from harness import choices as ch
from spendscope import names as n

SQL: dict[str, str] = {}

# -- text helpers -------------------------------------------------------------


def q(name: str) -> str:
    return f'"{name}"'


def cols(names) -> str:
    return ", ".join(q(x) for x in names)


def safe(a: str, b: str) -> str:
    return f"coalesce(case when {b} <> 0 and isfinite({a} / {b}) then {a} / {b} end, 0.0)"


def raw(a: str, b: str, scale: float = 1.0) -> str:
    return (f"(case when {b} = 0 then case when {a} > 0 then 'inf'::double when {a} < 0 then '-inf'::double end "
            f"else {a} / {b} end) * {scale}")


def sums(names) -> str:
    return ", ".join(f"coalesce(sum({q(x)}), 0.0) AS {q(x)}" for x in names)


def present(names) -> str:
    return " AND ".join(f"{q(x)} IS NOT NULL" for x in names)


def within(column: str, bounds) -> str:
    return f"{q(column)} BETWEEN date '{bounds[0]}' AND date '{bounds[1]}'"


def among(column: str, values) -> str:
    return f"{q(column)} IN ({', '.join(repr(v) for v in values)})"


def add(name: str, inner: str, text=(), num=(), day=(), whole=(), ctes: str = "") -> None:
    """Register a query; doubles get four decimals and dates ISO text."""
    shown = [
        *[q(x) for x in (*text, *whole)],
        *[f"round({q(x)} + 1e-9, 4) AS {q(x)}" for x in num],
        *[f"strftime({q(x)}, '%Y-%m-%d') AS {q(x)}" for x in day],
    ]
    SQL[name] = f"WITH {CTES}{ctes} SELECT {', '.join(shown)} FROM ({inner}) AS result"


# -- logical tables -----------------------------------------------------------

LABEL = ("case {k} % 4 when 0 then '2023-Q1' when 1 then '2022' when 2 then null else 'clearance' end")
NORM = r"upper(replace(regexp_replace({s}, '^\s+|\s+$', '', 'g'), chr(10), ''))"
GEN = ("case when contains({s}, '2023') then '2023新品' when contains({s}, '2022') or {s} is null then '老品' "
       "else {s} end")


def _fixed(fx: float, extra: str = "") -> str:
    first = ("case when mc = 569301767 then left(sku, greatest(length(sku) - 3, 0)) else sku end")
    return f"""
      SELECT case when ends_with(sku1, '-hm') then left(sku1, length(sku1) - 3) else sku1 end AS sku,
             case when mc = 569301767 then 9174985 else mc end AS mc, d, mon, pt1, pt2, pt3, country,
             campaign, campaign_id, lab, lab2, lab4, impression, click, conversions, 'USD' AS cur,
             case when cur = 'HKD' then cost * cast({fx} as double) else cost end AS cost,
             case when cur = 'HKD' then ads_value * cast({fx} as double) else ads_value end AS ads_value
      FROM (SELECT *, {first} AS sku1 FROM raw{extra})"""


ADS_SUMS = ("sum(impression) AS impression, sum(cost) AS cost, sum(click) AS click, "
            'sum(conversions) AS conversions, sum(ads_value) AS "ads value"')
SENSOR = ("sum(l_quantity) AS {sale}, sum(cast(floor(l_extendedprice * (1 - l_discount)) as double)) AS \"GMV\", "
          'cast(sum(l_linenumber) as double) AS "AddtoCart", '
          'sum(case when l_linenumber <= 2 then 0.0 else l_quantity * 3 end) AS "UV"')

CTES = f"""
raw AS (
  SELECT *,
    concat(case when l_linenumber = 7 then ' ' else '' end, 'sku-', l_partkey,
           case when l_returnflag = 'R' then '-hm' else '' end,
           case when l_linestatus = 'F' then '-xx' else '' end,
           case when l_linestatus = 'O' and l_linenumber = 6 then chr(10) else '' end) AS sku,
    cast(case when l_linestatus = 'F' then 569301767 else 9174985 end as bigint) AS mc,
    date '2023-01-01' + cast(date_diff('day', date '1995-01-02', cast(l_shipdate as date)) % 425 as int) AS d,
    cast(date_trunc('month', date '2023-01-01'
         + cast(date_diff('day', date '1995-01-02', cast(l_shipdate as date)) % 425 as int)) as date) AS mon,
    case when l_returnflag = 'A' then 'HKD' else 'USD' end AS cur,
    p_brand AS pt1, concat('S', p_size % 5) AS pt2, p_type AS pt3,
    case when l_suppkey % 17 = 0 then null else n_name end AS country,
    concat(o_orderpriority, '_', c_mktsegment) AS campaign, o_custkey % 50 AS campaign_id,
    l_quantity * 100 AS impression, cast(floor(l_extendedprice * l_discount / 10) as double) AS cost,
    case when l_linenumber = 1 then 0.0 else l_quantity end AS click,
    cast(l_linenumber as double) AS conversions, cast(floor(l_extendedprice / 10) as double) AS ads_value,
    {LABEL.format(k='l_partkey')} AS lab, concat('L', l_linenumber % 3) AS lab2,
    case when l_linenumber % 4 <> 0 then concat('M', l_partkey % 5) end AS lab4
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey),
dense AS (SELECT * FROM raw WHERE NOT (country IS NULL AND lab IS NULL AND lab4 IS NULL)),
fixed AS ({_fixed(0.127)}),
fixed_sku AS ({_fixed(0.13).replace('FROM raw', 'FROM dense')}),
ads_merged AS (SELECT sku, mc, d, cur, pt3, country, {ADS_SUMS} FROM fixed
  WHERE sku IS NOT NULL AND mc IS NOT NULL AND d IS NOT NULL AND pt3 IS NOT NULL AND country IS NOT NULL
  GROUP BY ALL),
ads_day AS (SELECT {NORM.format(s='sku')} AS "SKU", d AS "Date", pt3 AS "Product Type 3",
  impression, cost, click, conversions, "ads value" FROM ads_merged),
ads_mon AS (SELECT {NORM.format(s='sku')} AS "SKU", mon AS "Month", pt3 AS "Product Type 3",
  impression, cost, click, conversions, "ads value"
  FROM (SELECT sku, mc, mon, cur, pt3, country, {ADS_SUMS} FROM fixed
        WHERE sku IS NOT NULL AND mon IS NOT NULL AND pt3 IS NOT NULL AND country IS NOT NULL GROUP BY ALL)),
ads_sku_of AS (SELECT sku, mc, d, cur, pt1, pt2, pt3, {GEN.format(s='lab')} AS gen, country, impression, cost,
  click, conversions, ads_value FROM {{source}}),
ads_sku AS (SELECT {NORM.format(s='sku')} AS "SKU", d AS "Date", pt1 AS "Product Type 1", pt2 AS "Product Type 2",
  pt3 AS "Product Type 3", gen AS old_or_new, impression, cost, click, conversions, "ads value"
  FROM (SELECT sku, mc, d, cur, pt1, pt2, pt3, gen, country, {ADS_SUMS} FROM ads_sku_of
        WHERE sku IS NOT NULL AND d IS NOT NULL AND pt1 IS NOT NULL AND pt2 IS NOT NULL AND pt3 IS NOT NULL
          AND country IS NOT NULL GROUP BY ALL)),
ads_camp AS (SELECT campaign AS "Campaign", campaign_id AS "Campaign ID", {NORM.format(s='sku')} AS "SKU",
  d AS "Date", pt3 AS "Product Type 3", "Impression", cost, clicks, conversion, value
  FROM (SELECT campaign, campaign_id, mc, sku, d, cur, pt3, country, sum(impression) AS "Impression",
               sum(cost) AS cost, sum(click) AS clicks, sum(conversions) AS conversion, sum(ads_value) AS value
        FROM fixed WHERE campaign IS NOT NULL AND campaign_id IS NOT NULL AND sku IS NOT NULL AND d IS NOT NULL
          AND pt3 IS NOT NULL AND country IS NOT NULL GROUP BY ALL)),
sensor_day AS (SELECT concat('SKU-', l_partkey) AS "SKU", d AS "Date", {SENSOR.format(sale='"Sale"')}
  FROM raw WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2),
sensor_mon AS (SELECT concat('SKU-', l_partkey) AS "SKU", mon AS "Month", {SENSOR.format(sale='"Sale"')}
  FROM raw WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2),
sensor_camp AS (SELECT concat('SKU-', l_partkey) AS "SKU", campaign AS "Campaign", campaign_id AS "Campaign ID",
  d AS "Date", cast(count(distinct o_custkey) as double) AS saleuser, {SENSOR.format(sale='sale')}
  FROM raw WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2, 3, 4),
spu_sheet AS (
  SELECT case when p_partkey % 3 = 0 then concat(' sku-', p_partkey, chr(10)) else concat('SKU-', p_partkey) end
         AS "SKU", concat('SPU-', p_partkey % 200) AS "SPU" FROM part WHERE p_partkey % 11 <> 0
  UNION ALL SELECT concat('SKU-', p_partkey), 'SPU-DUP' FROM part WHERE p_partkey % 97 = 0),
spu AS (SELECT {NORM.format(s='"SKU"')} AS "SKU", "SPU" FROM spu_sheet),
label AS (SELECT concat('SKU-', p_partkey) AS "SKU", {LABEL.format(k='p_partkey')} AS customlabel1,
  case when p_partkey % 13 = 0 then null else p_retailprice end AS "Sale Price",
  concat('https://img/', p_partkey) AS imagelink FROM part WHERE p_partkey % 19 <> 0),
register AS (SELECT case when p_partkey % 11 <> 0 then concat('SPU-', p_partkey % 200) end AS "SPU",
  concat('https://img/', p_partkey) AS "图片" FROM part),
sensor_day_x AS (SELECT s.* FROM sensor_day s LEFT JOIN spu USING ("SKU") LEFT JOIN label USING ("SKU")),
sensor_mon_x AS (SELECT s.* FROM sensor_mon s LEFT JOIN spu USING ("SKU") LEFT JOIN label USING ("SKU")),
day_rows AS (SELECT a.*, spu."SPU", {GEN.format(s='label.customlabel1')} AS old_or_new, label."Sale Price",
  s."Sale", s."GMV", s."AddtoCart", s."UV"
  FROM ads_day a LEFT JOIN spu ON a."SKU" = spu."SKU" LEFT JOIN label ON a."SKU" = label."SKU"
       LEFT JOIN sensor_day_x s ON a."SKU" = s."SKU" AND a."Date" = s."Date"),
mon_rows AS (SELECT a.*, spu."SPU", {GEN.format(s='label.customlabel1')} AS old_or_new, label."Sale Price",
  s."Sale", s."GMV", s."AddtoCart", s."UV"
  FROM ads_mon a LEFT JOIN spu ON a."SKU" = spu."SKU" LEFT JOIN label ON a."SKU" = label."SKU"
       LEFT JOIN sensor_mon_x s ON a."SKU" = s."SKU" AND a."Month" = s."Month"),
camp_rows AS (SELECT a."Campaign", a."Campaign ID", a."SKU", a."Date", a."Product Type 3", a."Impression", a.cost,
  a.clicks, a.conversion, a.value, coalesce(spu."SPU", '0') AS "SPU", {GEN.format(s='label.customlabel1')} AS old_or_new,
  coalesce(label."Sale Price", 0.0) AS "Sale Price", coalesce(label.imagelink, '0') AS image,
  coalesce(s.saleuser, 0.0) AS saleuser, coalesce(s."GMV", 0.0) AS "GMV", coalesce(s."UV", 0.0) AS "UV",
  coalesce(s.sale, 0.0) AS sale, coalesce(s."AddtoCart", 0.0) AS "AddtoCart"
  FROM ads_camp a LEFT JOIN spu ON a."SKU" = spu."SKU" LEFT JOIN label ON a."SKU" = label."SKU"
       LEFT JOIN sensor_camp s ON a."Date" = s."Date" AND a."Campaign" = s."Campaign"
         AND a."Campaign ID" = s."Campaign ID" AND a."SKU" = s."SKU")
"""
_SOURCE = CTES
CTES = _SOURCE.replace("{source}", "fixed_sku")
WHOLE = _SOURCE.replace("{source}", f"({_fixed(0.13)})")

ADS, SENSORS = n.ADS_MEASURES, n.SENSOR_MEASURES
ALL = (*ADS, *SENSORS)
CAMP = n.CAMPAIGN_ADS_MEASURES
CSENSOR = n.CAMPAIGN_SENSOR_MEASURES
PT3 = "Product Type 3"

# -- scans --------------------------------------------------------------------

RAW_ADS = ('SELECT sku AS "SKU", mc AS "MC ID", d AS "Date", mon AS "Month", cur AS "Currency", '
           'pt1 AS "Product Type 1", '
           'pt2 AS "Product Type 2", pt3 AS "Product Type 3", country AS "Country", lab AS customlabel1, '
           'lab2 AS customlabel2, lab4 AS customlabel4, impression, cost, click, conversions, '
           'ads_value AS "ads value" FROM raw')
RAW_CAMPAIGN = ('SELECT campaign AS "Campaign", campaign_id AS "Campaign ID", sku AS "SKU", mc AS "MC ID", d AS "Date", '
                'cur AS currency, pt3 AS "Product Type 3", country AS "Country", impression AS "Impression", cost, '
                'click AS clicks, conversions AS conversion, ads_value AS value FROM raw')
add("a1_ads_daily", RAW_ADS,
    ["SKU", "Currency", "Product Type 1", "Product Type 2", PT3, "Country", "customlabel1", "customlabel2",
     "customlabel4"], ADS, ["Date"], ["MC ID"])
add("a1_ads_campaign_daily", RAW_CAMPAIGN, ["Campaign", "SKU", "currency", PT3, "Country"], CAMP, ["Date"],
    ["Campaign ID", "MC ID"])
add("a2_ads_monthly", RAW_ADS, ["SKU", "Currency", PT3, "Country"], ADS, ["Month"], ["MC ID"])
add("a3_sensor_daily", "SELECT * FROM sensor_day", ["SKU"], SENSORS, ["Date"])
add("a3_sensor_campaign_daily", "SELECT * FROM sensor_camp", ["SKU", "Campaign"], CSENSOR, ["Date"], ["Campaign ID"])
add("a4_sensor_monthly", "SELECT * FROM sensor_mon", ["SKU"], SENSORS, ["Month"])
add("a5_spu_index", "SELECT * FROM spu_sheet", ["SKU", "SPU"])
add("a6_product_label", "SELECT * FROM label", ["SKU", "customlabel1", "imagelink"], ["Sale Price"])
add("a9_canonical_headers", "SELECT * FROM sensor_mon", ["SKU"], SENSORS, ["Month"])

add("a8_written_and_read", "SELECT * FROM sensor_mon", ["SKU"], SENSORS, ["Month"])

_SPOILT = """SELECT *, impression = 4900 AS no_sku, click = 13 AS no_mc, day(d) = 31 AS no_date, cost <> 0 AND cost % 97 = 5 AS no_cost FROM raw"""
_REASONS = {"no_mc": "MC ID is no bigint", "no_date": "Date is no date", "no_cost": "cost is no double", "no_sku": "SKU is missing"}
add("a1_checked_rows",
    f"""SELECT sku AS "SKU", mc AS "MC ID", d AS "Date", cur AS "Currency", pt3 AS "Product Type 3", country AS "Country", impression,
      case when cost <> 0 then cost end AS cost, click, conversions, ads_value AS "ads value" FROM ({_SPOILT})
      WHERE NOT ({' OR '.join(_REASONS)})""", ["SKU", "Currency", PT3, "Country"], ADS, ["Date"], ["MC ID"])
_REASON = "concat_ws('; ', " + ", ".join(f"case when {k} then '{v}' end" for k, v in _REASONS.items()) + ")"
add("a1_rejects",
    f"""SELECT {_REASON} AS reason, case when no_date then strftime(d, '%d.%m.%Y') else strftime(d, '%Y-%m-%d') end AS "Date",
      case when cost = 0 then ' ' when no_cost then '12,5' else printf('%.1f', cost) end AS cost, case when no_mc then 'n/a' else mc::varchar end AS "MC ID",
      count(*) AS rows FROM ({_SPOILT}) WHERE {' OR '.join(_REASONS)} GROUP BY ALL""", ["reason", "Date", "cost", "MC ID"], whole=["rows"])
add("a1_reject_counts",
    f"SELECT NULL::varchar AS reason, count(*) AS rows FROM ({_SPOILT}) WHERE NOT ({' OR '.join(_REASONS)}) "
    + " ".join(f"UNION ALL SELECT '{v}', count(*) FROM ({_SPOILT}) WHERE {k}" for k, v in _REASONS.items()), ["reason"], whole=["rows"])

# -- filters and projections --------------------------------------------------


def counted(inner: str, *names: str, where: str = "true") -> str:
    return f"SELECT {cols(names)}, count(*) AS rows FROM ({inner}) WHERE {where} GROUP BY {cols(names)}"


add("b1_labelled_rows", counted(RAW_ADS, "SKU", "customlabel1", where="customlabel1 IS NOT NULL"),
    ["SKU", "customlabel1"], whole=["rows"])
add("b2_dense_rows",
    counted(RAW_ADS, "SKU", "Country", "customlabel1", "customlabel4",
            where='("Country" IS NULL)::int + (customlabel1 IS NULL)::int + (customlabel4 IS NULL)::int <= 2'),
    ["SKU", "Country", "customlabel1", "customlabel4"], whole=["rows"])
add("b3_date_range", f"SELECT * FROM sensor_day WHERE {within('Date', ch.BASE)}", ["SKU"], SENSORS, ["Date"])
add("b4_month_range", f"SELECT * FROM sensor_mon WHERE {within('Month', ch.YEAR)}", ["SKU"], SENSORS, ["Month"])
add("b5_chosen_members", f"SELECT * FROM spu_sheet WHERE {among('SPU', ch.SPUS)}", ["SKU", "SPU"])
add("b6_key_lines", f"SELECT * FROM spu_sheet WHERE {among('SPU', ch.SPUS)}", ["SKU", "SPU"])


def matches(pattern: str) -> str:
    return f"regexp_matches(\"Campaign\", '{pattern}', 'i')"


CONDITION = " AND ".join(
    [*[matches(p) for p in ch.CONDITION.all_of], matches("|".join(ch.CONDITION.any_of)),
     "NOT " + matches("|".join(ch.CONDITION.none_of))]
)
for _name, _test in {
    "b7_all_patterns": f"{matches('high|low')} AND {matches('BUILD')}",
    "b8_any_pattern": matches("^1-|furn"),
    "b9_no_pattern": f"NOT {matches('specified|auto')}",
    "b10_condition": CONDITION,
}.items():
    add(_name, counted("SELECT * FROM sensor_camp", "Campaign", "Campaign ID", where=_test),
        ["Campaign"], whole=["Campaign ID", "rows"])
add("b11_chosen_columns", "SELECT * FROM label", ["SKU"], ["Sale Price"])
add("b12_without_columns", "SELECT * FROM label", ["SKU"], ["Sale Price"])
add("b13_column_first", "SELECT * FROM label", ["SKU", "customlabel1", "imagelink"], ["Sale Price"])
add("b14_report_labels",
    'SELECT sum(impression) AS "展示", sum(cost) AS "费用", sum(click) AS "点击", sum(conversions) AS "ads转化", '
    'sum(ads_value) AS "ads value" FROM raw', num=["展示", "费用", "点击", "ads转化", "ads value"])

# -- row rules ----------------------------------------------------------------

add("c1_merchant_suffix",
    counted("SELECT case when mc = 569301767 then left(sku, length(sku) - 3) else sku end AS \"SKU\", mc AS \"MC ID\" "
            "FROM raw", "SKU", "MC ID"), ["SKU"], whole=["MC ID", "rows"])
add("c2_merchant_remap",
    counted('SELECT sku AS "SKU", case when mc = 569301767 then 9174985 else mc end AS "MC ID" FROM raw',
            "SKU", "MC ID"), ["SKU"], whole=["MC ID", "rows"])
add("c3_home_suffix",
    counted("SELECT case when ends_with(sku, '-hm') then left(sku, length(sku) - 3) else sku end AS \"SKU\" FROM raw",
            "SKU"), ["SKU"], whole=["rows"])
add("c4_report_currency",
    'SELECT sku AS "SKU", \'USD\' AS "Currency", '
    "case when cur = 'HKD' then cost * cast(0.127 as double) else cost end AS cost, "
    "case when cur = 'HKD' then ads_value * cast(0.127 as double) else ads_value end AS \"ads value\" FROM raw",
    ["SKU", "Currency"], ["cost", "ads value"])
add("c5_normalised_sku", counted(f'SELECT {NORM.format(s="sku")} AS "SKU" FROM raw', "SKU"), ["SKU"], whole=["rows"])
add("c6_generation", f'SELECT "SKU", {GEN.format(s="customlabel1")} AS old_or_new FROM label', ["SKU", "old_or_new"])
add("c7_filled_rows",
    counted(f"""SELECT a."SKU", coalesce(spu."SPU", '0') AS "SPU", {GEN.format(s='customlabel1')} AS old_or_new,
      coalesce("Sale Price", 0.0) AS "Sale Price", coalesce(imagelink, '0') AS imagelink
      FROM ads_camp a LEFT JOIN spu ON a."SKU" = spu."SKU" LEFT JOIN label ON a."SKU" = label."SKU" """,
            "SKU", "SPU", "old_or_new", "Sale Price", "imagelink"),
    ["SKU", "SPU", "old_or_new", "imagelink"], ["Sale Price"], whole=["rows"])
add("c8_parsed_dates", counted('SELECT d AS "Date" FROM raw', "Date"), day=["Date"], whole=["rows"])
add("c9_date_text",
    counted(f"SELECT strftime(d, '%Y-%m-%d') AS day, '{ch.BASE[0]}至{ch.BASE[1]}' AS \"日期范围\" FROM raw",
            "day", "日期范围"), ["day", "日期范围"], whole=["rows"])

# -- joins --------------------------------------------------------------------

add("d1_ads_with_spu", 'SELECT a.*, spu."SPU" FROM ads_day a LEFT JOIN spu ON a."SKU" = spu."SKU"',
    ["SKU", PT3, "SPU"], ADS, ["Date"])
add("d2_ads_with_label",
    f'SELECT a.*, {GEN.format(s="customlabel1")} AS old_or_new, "Sale Price" '
    'FROM ads_day a LEFT JOIN label ON a."SKU" = label."SKU"',
    ["SKU", PT3, "old_or_new"], [*ADS, "Sale Price"], ["Date"])
add("d3_sensor_by_products", "SELECT * FROM sensor_day_x", ["SKU"], SENSORS, ["Date"])
add("q2_enriched_daily", "SELECT * FROM day_rows", ["SKU", PT3, "SPU", "old_or_new"], [*ALL, "Sale Price"], ["Date"])
add("q3_enriched_monthly", "SELECT * FROM mon_rows", ["SKU", PT3, "SPU", "old_or_new"], [*ALL, "Sale Price"],
    ["Month"])
add("q4_enriched_campaign", "SELECT * FROM camp_rows", ["Campaign", "SKU", PT3, "SPU", "old_or_new", "image"],
    [*CAMP, *CSENSOR, "Sale Price"], ["Date"], ["Campaign ID"])

add("q4_enriched_campaign_sorted", 'SELECT * FROM camp_rows ORDER BY "SKU", "Date" DESC',
    ["Campaign", "SKU", PT3, "SPU", "old_or_new", "image"], [*CAMP, *CSENSOR, "Sale Price"], ["Date"], ["Campaign ID"])

# -- aggregates ---------------------------------------------------------------

add("q1_clean_ads", "SELECT * FROM ads_day", ["SKU", PT3], ADS, ["Date"])
add("e1_daily_merge",
    'SELECT *, sku AS "SKU", mc AS "MC ID", d AS "Date", cur AS "Currency", pt3 AS "Product Type 3", '
    'country AS "Country" FROM ads_merged'.replace("SELECT *,", 'SELECT impression, cost, click, conversions, "ads value",'),
    ["SKU", "Currency", PT3, "Country"], ADS, ["Date"], ["MC ID"])
SQL["e1_refreshed_by_deliveries"] = SQL["e1_daily_merge"]
add("e3_campaign_merge", "SELECT * FROM ads_camp", ["Campaign", "SKU", PT3], CAMP, ["Date"], ["Campaign ID"])
add("e4_monthly_merge", "SELECT * FROM ads_mon", ["SKU", PT3], ADS, ["Month"])
_DENSE, CTES = CTES, WHOLE
add("e2_sku_daily_merge", "SELECT * FROM ads_sku", ["SKU", "Product Type 1", "Product Type 2", PT3, "old_or_new"], ADS,
    ["Date"])
CTES = _DENSE

YEAR_DAYS = ("2023-01-01", "2023-12-31")
SKU_KEYS = ("SKU", "SPU", "Product Type 1", "Product Type 2", PT3, "old_or_new")


def period_ctes(name: str, bounds, extra: str = "true") -> str:
    """Sensor summary and SKU rows of one period, by the report's own steps."""
    keys = ("SKU", "SPU", *CSENSOR, "Product Type 1", "Product Type 2", PT3, "old_or_new", "神策加购率", "神策转化率")
    return f"""
{name}_sensor AS (SELECT *, {raw('saleuser', '"UV"')} AS "神策转化率", {raw('"AddtoCart"', '"UV"')} AS "神策加购率"
  FROM (SELECT s."SKU", p."SPU", {', '.join(f'coalesce(sum(s.{q(x)}), 0.0) AS {q(x)}' for x in CSENSOR)}
        FROM sensor_camp s LEFT JOIN spu_sheet p ON s."SKU" = p."SKU"
        WHERE {within('Date', bounds)} AND ({extra}) AND s."SKU" IS NOT NULL AND p."SPU" IS NOT NULL GROUP BY 1, 2)),
{name}_ads AS (SELECT a.*, p."SPU" FROM ads_sku a LEFT JOIN spu_sheet p ON a."SKU" = p."SKU"
  WHERE {within('Date', bounds)}),
{name}_rows AS (SELECT *, {safe('"GMV"', 'cost')} AS "神策ROI", {safe('"ads value"', 'cost')} AS "ads ROI",
    {safe('cost', 'click')} AS "CPC", {raw('click', 'impression')} AS "CTR",
    saleuser AS "支付用户数", sale AS "销量", "AddtoCart" AS "加购", impression AS "展示", cost AS "费用",
    click AS "点击", conversions AS "ads转化"
  FROM (SELECT {cols(keys)}, {sums(ADS)}
        FROM (SELECT a.*, s.* EXCLUDE ("SKU", "SPU") FROM {name}_ads a LEFT JOIN {name}_sensor s
              ON a."SKU" = s."SKU" AND a."SPU" = s."SPU") WHERE {present(keys)} GROUP BY {cols(keys)}))"""


add("e5_sensor_summary", "SELECT * FROM y_sensor", ["SKU", "SPU"], [*CSENSOR, "神策转化率", "神策加购率"],
    ctes="," + period_ctes("y", YEAR_DAYS))

TOTALS = n.PERIOD_MEASURES
RATIOS = n.PERIOD_RATIOS


def total_row(kind: str, bounds) -> str:
    ratios = {
        "神策转化率": raw('"支付用户数"', '"UV"'), "神策加购率": raw('"加购"', '"UV"'),
        "点击率": raw('"点击"', '"展示"'), "ads ROI": raw('"ads value"', '"费用"'),
        "神策 ROI": raw('"GMV"', '"费用"'), "CPC": raw('"费用"', '"点击"'),
    }
    return (f"SELECT '{kind}' AS row_kind, '{bounds[0]}至{bounds[1]}' AS \"日期范围\", *, "
            + ", ".join(f"{expr} AS {q(name)}" for name, expr in ratios.items())
            + f" FROM (SELECT {sums(TOTALS)} FROM {kind}_rows)")


def change_row() -> str:
    changes = ", ".join(
        f"case when b.{q(x)} <> 0 and not isnan((k.{q(x)} - b.{q(x)}) / b.{q(x)}) "
        f"then (k.{q(x)} - b.{q(x)}) / b.{q(x)} end AS {q(x)}" for x in (*TOTALS, *RATIOS)
    )
    return f"SELECT 'change' AS row_kind, '对比' AS \"日期范围\", {changes} FROM base_total b, compare_total k"


def comparison_ctes(base: str = "true", compare: str = "true") -> str:
    return (f",{period_ctes('base', ch.BASE, base)},{period_ctes('compare', ch.OTHER, compare)}, "
            f"base_total AS ({total_row('base', ch.BASE)}), compare_total AS ({total_row('compare', ch.OTHER)}), "
            f"change_total AS ({change_row()}), "
            "all_totals AS (SELECT * FROM base_total UNION ALL BY NAME SELECT * FROM compare_total "
            "UNION ALL BY NAME SELECT * FROM change_total)")


add("e7_period_total", total_row("base", YEAR_DAYS), ["row_kind", "日期范围"], [*TOTALS, *RATIOS],
    ctes="," + period_ctes("base", YEAR_DAYS))


def rollup(source: str, keys, where: str = "true", measures=ALL) -> str:
    return (f"SELECT {cols(keys)}, {sums(measures)} FROM {source} WHERE {present(keys)} AND {where} "
            f"GROUP BY {cols(keys)}")


add("e8_month_rollup", rollup("mon_rows", ["Month"]), num=ALL, day=["Month"])
add("e9_day_rollup", rollup("day_rows", ["Date"]), num=ALL, day=["Date"])
add("e10_spu_rollup", rollup("day_rows", ["SPU", PT3]), ["SPU", PT3], ALL)
add("e11_sku_rollup", rollup("day_rows", ["SKU", "SPU", PT3, "old_or_new"]), ["SKU", "SPU", PT3, "old_or_new"], ALL)
YEAR_KEYS = ("SPU", "SKU", PT3, "old_or_new", "Sale Price")
add("e12_price_rollup", rollup("mon_rows", YEAR_KEYS), YEAR_KEYS[:4], ["Sale Price", *ALL])

PRODUCT = ("SKU", "SPU", PT3, "old_or_new", "Sale Price", "image")
POINTS = ("cost", "clicks", "Impression", "GMV", "UV", "value", "conversion", "sale", "saleuser", "AddtoCart")


def points(bounds, where: str = "true") -> str:
    rows = f"(SELECT *, {safe('cost', 'clicks')} AS \"CPC\" FROM camp_rows WHERE {within('Date', bounds)} AND {where})"
    return rollup(rows, [*PRODUCT, "Date", "CPC"], measures=POINTS)


add("e13_campaign_points", points(YEAR_DAYS), ["SKU", "SPU", PT3, "old_or_new", "image"],
    ["Sale Price", "CPC", *POINTS], ["Date"])
add("e15_product_totals",
    f'SELECT {cols(PRODUCT)}, sum(cost) AS cost_sum, sum("GMV") AS gmv_sum FROM camp_rows '
    f'WHERE {within("Date", YEAR_DAYS)} GROUP BY {cols(PRODUCT)}',
    ["SKU", "SPU", PT3, "old_or_new", "image"], ["Sale Price", "cost_sum", "gmv_sum"])
add("e16_first_rows",
    'SELECT "SKU", customlabel1, customlabel2, any_value("Product Type 1") AS "Product Type 1", '
    f'any_value("Product Type 3") AS "Product Type 3" FROM ({RAW_ADS}) '
    'WHERE "SKU" IS NOT NULL AND customlabel1 IS NOT NULL AND customlabel2 IS NOT NULL GROUP BY 1, 2, 3',
    ["SKU", "customlabel1", "customlabel2", "Product Type 1", PT3])
add("e17_range_total", f"SELECT {sums(ALL)} FROM day_rows WHERE {within('Date', YEAR_DAYS)}", num=ALL)
add("e18_range_mean",
    f"SELECT {', '.join(f'{q(x)} / 364.0 AS {q(x)}' for x in ALL)} FROM "
    f"(SELECT {sums(ALL)} FROM day_rows WHERE {within('Date', YEAR_DAYS)})", num=ALL)
add("e19_date_extremes", 'SELECT min(d) AS "min_Date", max(d) AS "max_Date" FROM raw', day=["min_Date", "max_Date"])
add("e19_stored_extremes",
    'SELECT min(d) AS "min_Date", max(d) AS "max_Date", min(cost) AS min_cost, max(cost) AS max_cost FROM raw',
    num=["min_cost", "max_cost"], day=["min_Date", "max_Date"])
add("e20_column_maxima", f"SELECT {', '.join(f'max({q(x)}) AS {q(x)}' for x in SENSORS)} FROM sensor_day", num=SENSORS)
add("e21_distinct_campaigns", 'SELECT DISTINCT campaign AS "Campaign" FROM raw', ["Campaign"])

# -- ratios -------------------------------------------------------------------


def with_ratios(inner: str, scale: float, roi: str = "神策ROI") -> str:
    return (f"SELECT *, {safe('\"GMV\"', 'cost')} AS {q(roi)}, {safe('\"ads value\"', 'cost')} AS \"ads ROI\", "
            f"{safe('cost', 'click')} AS \"CPC\", {raw('click', 'impression', scale)} AS \"CTR\", "
            f"{raw('\"Sale\"', '\"UV\"', scale)} AS \"神策转化率\", "
            f"{raw('\"AddtoCart\"', '\"UV\"', scale)} AS \"神策加购率\" FROM ({inner})")


for _name, _column, _scale in [
    ("f1_sensor_roi", "神策ROI", 1.0), ("f2_ads_roi", "ads ROI", 1.0), ("f3_cpc", "CPC", 1.0),
    ("f4_ctr", "CTR", 100.0), ("f5_conversion", "神策转化率", 100.0), ("f6_add_to_cart", "神策加购率", 1.0),
]:
    add(_name, with_ratios(rollup("day_rows", ["SKU", "Date"]), _scale), ["SKU"], [_column], ["Date"])

SPREAD = ("case when \"Month\" between date '2023-01-01' and date '2024-01-01' "
          "then cast(day(last_day(\"Month\")) as double) else 1.0 end")
add("f8_daily_means", f'SELECT "SKU", "Month", {", ".join(f"{q(x)} / {SPREAD} AS {q(x)}" for x in SENSORS)} '
    "FROM sensor_mon", ["SKU"], SENSORS, ["Month"])

# -- reports ------------------------------------------------------------------

SHOWN = ('cost AS "费用", click AS "点击", "GMV", "ads value", "神策ROI", "ads ROI", "Sale" AS "销量", "CPC", "CTR", '
         '"神策转化率", "神策加购率", impression AS "展示", "UV"')


def report(inner: str, keys=(), scale: float = 100.0) -> str:
    return f"SELECT {cols(keys) + ', ' if keys else ''}{SHOWN} FROM ({with_ratios(inner, scale)})"


DAY = n.DAY_REPORT
OF_SPUS = among("SPU", ch.SPUS)
IN_BASE = within("Date", ch.BASE)
_MEANS = (f"SELECT \"Month\", {', '.join(f'sum({q(x)} / {SPREAD}) AS {q(x)}' for x in ALL)} FROM mon_rows "
          f"WHERE {OF_SPUS} AND \"Month\" IS NOT NULL GROUP BY 1")
_FILLED = f"SELECT \"Month\", {', '.join(f'coalesce({q(x)}, 0.0) AS {q(x)}' for x in ALL)} FROM ({_MEANS})"
add("q5_month_history",
    'SELECT "Month", cost AS "日均费用", click AS "日均点击", "GMV" AS "日均GMV", "ads value" AS "日均ads value", '
    '"神策ROI", "ads ROI", "Sale" AS "日均销量", "CPC", "CTR", "神策转化率", "神策加购率", impression AS "日均展示" '
    f"FROM ({with_ratios(_FILLED, 100.0)})", num=n.MONTH_REPORT, day=["Month"])
add("q6_day_detail", report(rollup("day_rows", ["Date"], OF_SPUS), ["Date"]), num=DAY, day=["Date"])
_TOTAL = f"SELECT {sums(ALL)} FROM day_rows WHERE {OF_SPUS} AND {IN_BASE}"
add("q7_range_mean",
    report(f"SELECT {', '.join(f'{q(x)} / 6.0 AS {q(x)}' for x in ALL)} FROM ({_TOTAL})", scale=1.0), num=DAY)
add("q8_range_total", report(_TOTAL, scale=1.0), num=DAY)


def as_text(inner: str, layout, keys, exact: bool = True) -> str:
    styles = {"2": "printf('%.2f', {x})", "%": "printf('%.2f%%', {x} * 100)", "r": "printf('%.1f', {x})"}
    shown = []
    for name, style in layout.items():
        tail = "%" if style == "%" else ""
        x = q(name)
        shown.append(f"case when {x} is null then null when {x} = 'inf'::double then 'inf{tail}' "
                     f"else {styles[style].format(x=x)} end AS {x}")
    rounded = ", ".join(f"round({q(x)} + 1e-9, 4) AS {q(x)}" for x in layout) if exact else "*"
    kept = f"{cols(keys)}, " if keys and exact else ""
    return (f"SELECT {cols(keys) + ', ' if keys else ''}{', '.join(shown)} "
            f"FROM (SELECT {kept}{rounded} FROM ({inner}))")


add("q8_range_total_text",
    as_text(report(_TOTAL, scale=1.0), n.RANGE_TEXT, ["展示", "UV"]), list(n.RANGE_TEXT), ["展示", "UV"])
_TREND = report(rollup("day_rows", ["SPU", PT3], IN_BASE), ["SPU", PT3])
add("e20_report_maxima", f"SELECT {', '.join(f'max({q(x)}) AS {q(x)}' for x in DAY)} FROM ({_TREND})", num=DAY)
add("q9_spu_trend", _TREND, ["SPU", PT3], DAY)
add("q9_spu_trend_of_categories", f"SELECT * FROM ({_TREND}) WHERE {among(PT3, ch.CATEGORIES)}", ["SPU", PT3], DAY)
_DRILL = ("SKU", "SPU", PT3, "old_or_new")
add("q10_spu_skus", report(rollup("day_rows", _DRILL, f"{OF_SPUS} AND {IN_BASE}"), _DRILL), _DRILL, DAY)
add("q10_spu_skus_of_keys", report(rollup("day_rows", _DRILL, f"{OF_SPUS} AND {IN_BASE}"), _DRILL), _DRILL, DAY)

# -- many ranges, each by its own pass over the rows


def ranges(length: int) -> str:
    return f'(SELECT DISTINCT d AS first, d + {length - 1} AS last FROM raw)'


def summed_ranges(length: int, where: str = "true", keys: str = "") -> str:
    rows = f"(SELECT * FROM day_rows WHERE {where})"
    spus = f"CROSS JOIN (SELECT DISTINCT \"SPU\" FROM spu_sheet WHERE {where})" if keys else ""
    same = 'AND x."SPU" = g."SPU"' if keys else ""
    shown = 'g."SPU", ' if keys else ""
    measures = ", ".join(f"coalesce(sum(x.{q(m)}), 0.0) AS {q(m)}" for m in ALL)
    return (f"SELECT {shown}g.first, g.last, {measures} FROM (SELECT * FROM {ranges(length)} {spus}) g "
            f"LEFT JOIN {rows} x ON x.\"Date\" BETWEEN g.first AND g.last {same} GROUP BY {shown}g.first, g.last")


add("e17_many_ranges", summed_ranges(30), num=ALL, day=["first", "last"])
add("q8_many_ranges", report(summed_ranges(7, OF_SPUS), ["first", "last"], scale=1.0), num=DAY, day=["first", "last"])
add("q8_many_ranges_by_spu", report(summed_ranges(7, OF_SPUS, "SPU"), ["SPU", "first", "last"], scale=1.0), ["SPU"], DAY, ["first", "last"])
add("q7_many_ranges",
    report(f"SELECT first, last, {', '.join(f'{q(x)} / 6.0 AS {q(x)}' for x in ALL)} FROM ({summed_ranges(7, OF_SPUS)})", ["first", "last"], scale=1.0),
    num=DAY, day=["first", "last"])
_NEXT = summed_ranges(7, OF_SPUS).replace(ranges(7), "(SELECT DISTINCT d + 7 AS first, d + 13 AS last FROM raw)")
add("q14_many_ranges",
    "SELECT b.first, b.last, " + ", ".join(f"case when b.{q(x)} <> 0 then (k.{q(x)} - b.{q(x)}) / b.{q(x)} end AS {q(x)}" for x in ALL)
    + f" FROM ({summed_ranges(7, OF_SPUS)}) b JOIN ({_NEXT}) k ON k.first = b.first + 7", num=ALL, day=["first", "last"])

WEEK = [f"2023-06-0{i}" for i in range(1, 8)]


def matrix(source: str, keys, where: str) -> str:
    days = ", ".join(f"sum(case when \"Date\" = date '{d}' then cost end) AS {q(d)}" for d in WEEK)
    return f"SELECT {cols(keys)}, {days} FROM {source} WHERE {present(keys)} AND {where} GROUP BY {cols(keys)}"


def band(x: str) -> str:
    return (f"case when {x} is null or {x} = 0 then 'none' when {x} > 0 and {x} < 50 then 'low' "
            f"when {x} >= 50 and {x} < 150 then 'mid' else 'high' end")


_MATRIX = matrix("day_rows", ["SPU", "SKU", "old_or_new"], f"{OF_SPUS} AND {IN_BASE}")
add("q11_spu_cost_matrix",
    f"SELECT *, {', '.join(f'{band(q(d))} AS {q(d + ' band')}' for d in WEEK)} FROM ({_MATRIX})",
    ["SPU", "SKU", "old_or_new", *[d + " band" for d in WEEK]], WEEK)
MAPPED = [(date(2023, 1, 1) + timedelta(days=i)).isoformat() for i in range(425)]
_CELLS = ", ".join(f"sum(case when \"Date\" = date '{d}' then cost end) AS {q(d)}" for d in MAPPED)
_KEYS = ["SPU", "SKU", "old_or_new"]
for _name in ("q11_spu_cost_matrix_every_day", "q11_spu_cost_matrix_all_days"):
    add(_name, f"SELECT *, {', '.join(f'{band(q(d))} AS {q(d + ' band')}' for d in MAPPED)} FROM "
        f"(SELECT {cols(_KEYS)}, {_CELLS} FROM day_rows WHERE {present(_KEYS)} AND {OF_SPUS} GROUP BY {cols(_KEYS)})",
        [*_KEYS, *[d + " band" for d in MAPPED]], MAPPED)


def vectors(source: str, keys, where: str, bands: bool = False) -> str:
    """Lists of days and their sums, in day order."""
    more = f", string_agg({band('cost')}, ',' ORDER BY \"Date\") AS band" if bands else ""
    return f"""SELECT {cols(keys)}, string_agg(strftime("Date", '%Y-%m-%d'), ',' ORDER BY "Date") AS "Date",
      string_agg(printf('%.4f', cost + 1e-9), ',' ORDER BY "Date") AS cost{more}
      FROM (SELECT {cols(keys)}, "Date", sum(cost) AS cost FROM {source} WHERE {present(keys)} AND "Date" IS NOT NULL AND {where}
            GROUP BY {cols(keys)}, "Date") GROUP BY {cols(keys)}"""


add("q11_spu_cost_vectors", vectors("day_rows", _KEYS, OF_SPUS, bands=True), [*_KEYS, "Date", "cost", "band"])
add("q11_spu_cost_vectors_long",
    f"""SELECT {cols(_KEYS)}, "Date", sum(cost) AS cost FROM day_rows
      WHERE {present(_KEYS)} AND {OF_SPUS} AND {within('Date', YEAR_DAYS)} GROUP BY {cols(_KEYS)}, "Date" """,
    _KEYS, ["cost"], day=["Date"])

_YEAR = with_ratios(rollup("mon_rows", YEAR_KEYS, within("Month", ch.YEAR)), 1.0, "Sensor ROI")
_YEAR_NUM = ["Sale Price", *ALL, "Sensor ROI", "ads ROI", "CTR"]
add("q12_yearly_summary", _YEAR, YEAR_KEYS[:4], _YEAR_NUM)
add("g2_summary_by_spu", _YEAR, YEAR_KEYS[:4], _YEAR_NUM)
add("q12_spu_lookup",
    f"""SELECT *, case when "Sensor ROI" < 1.5 then 'weak' when "Sensor ROI" > 2.5 then 'strong' else 'none' end
      AS roi_band, case old_or_new when '2023新品' then 'new' when '老品' then 'old' else 'other' end AS generation_flag
      FROM ({_YEAR}) WHERE {OF_SPUS}""", [*YEAR_KEYS[:4], "roi_band", "generation_flag"], _YEAR_NUM)
add("q12_spu_lookup_text", as_text(f"SELECT * FROM ({_YEAR}) WHERE {OF_SPUS}", n.YEAR_TEXT, ["SPU", "SKU"]),
    ["SPU", "SKU", *n.YEAR_TEXT])
add("g4_spu_category",
    f'SELECT upper("Product Type 3") AS "Product Type 3" FROM ({_YEAR}) WHERE {OF_SPUS} '
    'ORDER BY "SPU", "SKU", "Product Type 3" LIMIT 1', [PT3])

_SKU_NUM = ["支付用户数", "销量", "GMV", "UV", "加购", "神策转化率", "神策加购率", "展示", "费用", "点击", "ads转化",
            "ads value", "神策ROI", "ads ROI", "CPC", "CTR"]
CHOSEN = among("SKU", ch.SKUS).replace('"SKU"', 's."SKU"')
for _name, _extra in {
    "q13_sku_period": "true",
    "q13_sku_period_condition": CONDITION,
    "q13_sku_period_skus": f"{CONDITION} AND {CHOSEN}",
    "q13_sku_period_skus_only": CHOSEN,
}.items():
    add(_name, "SELECT * FROM base_rows", SKU_KEYS, _SKU_NUM, ctes="," + period_ctes("base", ch.BASE, _extra))
add("q13_sku_period_text", as_text("SELECT * FROM base_rows", n.SKU_TEXT, SKU_KEYS), [*SKU_KEYS, *n.SKU_TEXT],
    ctes="," + period_ctes("base", ch.BASE))

_TOTAL_NUM = [*TOTALS, *RATIOS]
add("h1_two_periods", "SELECT * FROM base_total UNION ALL BY NAME SELECT * FROM compare_total",
    ["row_kind", "日期范围"], _TOTAL_NUM, ctes=comparison_ctes())
for _name, _base, _compare in [
    ("q14_compare_periods", "true", "true"),
    ("q14_compare_condition", CONDITION, "true"),
    ("q14_compare_condition_both", CONDITION, CONDITION),
    ("q14_compare_skus_only", CHOSEN, CHOSEN),
    ("q14_compare_skus", f"{CONDITION} AND {CHOSEN}", f"{CONDITION} AND {CHOSEN}"),
]:
    add(_name, "SELECT * FROM all_totals", ["row_kind", "日期范围"], _TOTAL_NUM, ctes=comparison_ctes(_base, _compare))
add("g5_change_row", "SELECT * FROM change_total", ["row_kind", "日期范围"], _TOTAL_NUM, ctes=comparison_ctes())
_CHANGE_TEXT = ", ".join(
    f"case when b.{q(x)} = 0 then '' else coalesce(printf('%.2f%%', c.{q(x)} * 100), 'nan%') end AS {q(x)}"
    for x in n.TOTAL_TEXT
)
add("j3_comparison_text",
    f"""{as_text('SELECT * FROM base_total UNION ALL BY NAME SELECT * FROM compare_total', n.TOTAL_TEXT,
                 ['row_kind', '日期范围'], exact=False)} UNION ALL BY NAME
      SELECT 'change' AS row_kind, '对比' AS "日期范围", {_CHANGE_TEXT} FROM base_total b, change_total c""",
    ["row_kind", "日期范围", *n.TOTAL_TEXT], ctes=comparison_ctes())
add("k3_change_direction",
    "SELECT " + ", ".join(
        f"case when round({q(x)} * 100, 2) <= 0 then 'down' when round({q(x)} * 100, 2) > 0 then 'up' else 'none' end "
        f"AS {q(x + ' direction')}" for x in _TOTAL_NUM) + " FROM change_total",
    [x + " direction" for x in _TOTAL_NUM], ctes=comparison_ctes())
add("q15_sku_cost_matrix",
    matrix('(SELECT a.* FROM ads_sku a LEFT JOIN spu_sheet p ON a."SKU" = p."SKU")', ["SKU"],
           f"{among('SKU', ch.SKUS)} AND {IN_BASE}"), ["SKU"], WEEK)

add("q15_sku_cost_vectors",
    vectors('(SELECT a.* FROM ads_sku a LEFT JOIN spu_sheet p ON a."SKU" = p."SKU")', ["SKU"], among("SKU", ch.SKUS)),
    ["SKU", "Date", "cost"])

LISTS = ("CPC", *POINTS)


def series(bounds, where: str = "true") -> str:
    """The page's own steps: points sorted by their keys, lists per product, its two totals joined on."""
    lists = ", ".join(f"string_agg(printf('%.4f', {q(x)} + 1e-9), ',' ORDER BY \"Date\", \"CPC\") AS {q(x)}" for x in LISTS)
    days = "string_agg(strftime(\"Date\", '%Y-%m-%d'), ',' ORDER BY \"Date\", \"CPC\") AS \"Date\""
    rows = f"FROM camp_rows WHERE {within('Date', bounds)} AND {where} GROUP BY {cols(PRODUCT)}"
    return f"""SELECT l.*, g.gmv_sum, c.cost_sum
      FROM (SELECT {cols(PRODUCT)}, {lists}, {days} FROM ({points(bounds, where)}) GROUP BY {cols(PRODUCT)}) l
      LEFT JOIN (SELECT {cols(PRODUCT)}, sum("GMV") AS gmv_sum {rows}) g USING ({cols(PRODUCT)})
      LEFT JOIN (SELECT {cols(PRODUCT)}, sum(cost) AS cost_sum {rows}) c USING ({cols(PRODUCT)})"""


def day_series(bounds, where: str = "true") -> str:
    lists = ", ".join(f"string_agg(printf('%.4f', {q(x)} + 1e-9), ',' ORDER BY \"CPC\") AS {q(x)}" for x in LISTS)
    keys = ", ".join(f"p.{q(x)}" for x in PRODUCT)
    renamed = lists.replace('AS "', 'AS "list_')
    return f"""SELECT {cols(PRODUCT)}, "Date", sum(day_cost) OVER w AS cost_sum, sum(day_gmv) OVER w AS gmv_sum,
      (sum(n) OVER w)::bigint AS points, {', '.join(f'{q("list_" + x)} AS {q(x)}' for x in LISTS)}
      FROM (SELECT {keys}, p."Date", {renamed}, sum(cost) AS day_cost, sum("GMV") AS day_gmv, count(*) AS n
            FROM ({points(bounds, where)}) p GROUP BY {keys}, p."Date") WINDOW w AS (PARTITION BY {cols(PRODUCT)})"""


_SERIES_TEXT = ["SKU", "SPU", PT3, "old_or_new", "image", *LISTS]
for _name, _sql in {
    "q16_campaign_series": series(ch.BASE),
    "q16_campaign_series_chosen": series(YEAR_DAYS, among("Campaign", ch.CAMPAIGNS)),
    "q16_campaign_series_of_keys": series(ch.BASE, among("Campaign", ch.CAMPAIGNS)),
}.items():
    add(_name, _sql, [*_SERIES_TEXT, "Date"], ["Sale Price", "cost_sum", "gmv_sum"])
for _name, _sql in {
    "q16_campaign_days": day_series(ch.BASE),
    "q16_campaign_days_chosen": day_series(YEAR_DAYS, among("Campaign", ch.CAMPAIGNS)),
}.items():
    add(_name, _sql, _SERIES_TEXT, ["Sale Price", "cost_sum", "gmv_sum"], day=["Date"], whole=["points"])
add("q17_campaigns_in_range", f'SELECT DISTINCT "Campaign" FROM camp_rows WHERE {IN_BASE}', ["Campaign"])
_LABEL_KEYS = ["SPU", "SKU", "费用", "GMV", "点击", "支付用户数", "神策ROI", "ads ROI", "customlabel2", "customlabel4",
               "Product Type 1", "Product Type 2", "Product Type 3", "old_or_new", "神策加购率", "神策转化率"]
_LABEL_REST = [x for x in [*SKU_KEYS, *_SKU_NUM] if x not in _LABEL_KEYS]
add("q18_custom_labels",
    f"""SELECT {cols(_LABEL_KEYS)}, {', '.join(f'first({q(x)}) AS {q(x)}' for x in _LABEL_REST)}
      FROM base_rows LEFT JOIN
      (SELECT {NORM.format(s='sku')} AS "SKU", lab2 AS customlabel2, lab4 AS customlabel4 FROM fixed_sku) USING ("SKU")
      WHERE {present(_LABEL_KEYS)} GROUP BY {cols(_LABEL_KEYS)}""",
    [*SKU_KEYS, "customlabel2", "customlabel4"], _SKU_NUM, ctes="," + period_ctes("base", ch.BASE))
add("q19_spu_register", 'SELECT * FROM register WHERE "SPU" IS NOT NULL', ["SPU", "图片"])

# -- SKU pruning plan ----------------------------------------------------------

_RULES = ch.PRUNING
_CATEGORIES = ", ".join(repr(x.lower()) for x in _RULES.categories)
_OUT = ", ".join(repr(x.lower()) for x in _RULES.left_out)
_PRUNING = f""",
year_rows AS (SELECT * FROM mon_rows WHERE "SPU" IS NOT NULL AND "SKU" IS NOT NULL AND {present([PT3])} AND {within('Month', _RULES.months)}),
departments AS (SELECT DISTINCT {NORM.format(s='sku')} AS "SKU", pt1 FROM (
  SELECT case when ends_with(sku1, '-hm') then left(sku1, length(sku1) - 3) else sku1 end AS sku, pt1 FROM
    (SELECT case when mc = 569301767 then left(sku, greatest(length(sku) - 3, 0)) else sku end AS sku1, pt1 FROM raw))),
months AS (SELECT unnest(generate_series(date '{_RULES.trend_months[0]}', date '{_RULES.trend_months[1]}', interval 1 month))::date AS "Month"),
trends AS (
  SELECT "SPU", "SKU", regr_slope(gmv, x) AS gmv_trend, regr_slope(value, x) AS ads_value_trend
  FROM (SELECT k."SPU", k."SKU", date_diff('month', date '2020-01-01', months."Month") AS x, coalesce(sum(r."GMV"), 0) AS gmv,
          coalesce(sum(r."ads value"), 0) AS value
        FROM (SELECT DISTINCT "SPU", "SKU" FROM year_rows) k CROSS JOIN months
          LEFT JOIN year_rows r ON r."SPU" = k."SPU" AND r."SKU" = k."SKU" AND r."Month" = months."Month" GROUP BY ALL)
  GROUP BY "SPU", "SKU"),
skus AS (
  SELECT "SPU", "SKU", {', '.join(f'coalesce(sum({q(x)}), 0.0) AS {q(x)}' for x in ALL)}, sum(cost) / 12.0 AS sku_mean_cost
  FROM year_rows GROUP BY "SPU", "SKU"),
families AS (
  SELECT "SPU", count(DISTINCT "SKU") AS sku_count, sum(cost) / 12.0 AS mean_cost, coalesce(sum("GMV"), 0.0) / 12.0 AS mean_gmv,
    {safe('sum("GMV") FILTER (' + within('Month', _RULES.return_months) + ')', 'sum(cost) FILTER (' + within('Month', _RULES.return_months) + ')')} AS "return",
    bool_or(lower("Product Type 3") IN ({_CATEGORIES})) AS in_category,
    bool_or("SKU" IN (SELECT "SKU" FROM departments WHERE lower(pt1) IN ({_OUT}))) AS left_out
  FROM year_rows GROUP BY "SPU"),
judged AS (
  SELECT *, mean_cost > {_RULES.cost_above} AS costs_enough, mean_gmv < {_RULES.gmv_below} AS earns_little,
    "return" < {_RULES.return_below} AS returns_little, sku_count >= {_RULES.least_skus} AS has_skus FROM families),
qualification AS (
  SELECT *, in_category AND NOT left_out AND costs_enough AND earns_little AND returns_little AND has_skus AS qualified FROM judged),
shares AS (
  SELECT s.*, f.family_share, s.sku_mean_cost > f.family_share AS above_share, g.qualified
  FROM skus s JOIN (SELECT "SPU", sum(cost) / 12.0 / count(*) AS family_share FROM skus GROUP BY "SPU") f USING ("SPU") JOIN qualification g USING ("SPU"))"""
_RULE_FLAGS = ["in_category", "left_out", "costs_enough", "earns_little", "returns_little", "has_skus", "qualified"]
add("q20_spu_qualification", "SELECT * FROM qualification", ["SPU"], ["mean_cost", "mean_gmv", "return"], whole=["sku_count", *_RULE_FLAGS], ctes=_PRUNING)
add("q21_sku_family_share", "SELECT * FROM shares", ["SPU", "SKU"], ["sku_mean_cost", "family_share"], whole=["above_share"], ctes=_PRUNING)
add("q22_gmv_trends", "SELECT * FROM trends", ["SPU", "SKU"], ["gmv_trend", "ads_value_trend"], ctes=_PRUNING)
add("q23_pruning_plan",
    f"""SELECT "SPU", "SKU", (row_number() OVER (PARTITION BY "SPU" ORDER BY sensor_roi, ads_roi, gmv_trend, ads_value_trend, ctr NULLS LAST, "SKU"))::int AS rank,
      sku_mean_cost, family_share, sensor_roi, ads_roi, gmv_trend, ads_value_trend, ctr
      FROM (SELECT s.*, t.gmv_trend, t.ads_value_trend, {safe('"GMV"', 'cost')} AS sensor_roi, {safe('"ads value"', 'cost')} AS ads_roi,
              {raw('click', 'impression')} AS ctr
            FROM shares s JOIN trends t USING ("SPU", "SKU")
            WHERE above_share AND qualified AND s."SKU" NOT IN (SELECT "SKU" FROM label WHERE customlabel1 = 'clearance'))
      QUALIFY rank <= 3""",
    ["SPU", "SKU"], ["sku_mean_cost", "family_share", "sensor_roi", "ads_roi", "gmv_trend", "ads_value_trend", "ctr"], whole=["rank"], ctes=_PRUNING)

# -- bands --------------------------------------------------------------------

add("k1_cost_band", counted(f'SELECT "SKU", {band("cost")} AS band FROM ads_day', "SKU", "band"), ["SKU", "band"],
    whole=["rows"])
add("k2_roi_band",
    f"""SELECT "SKU", "Date", case when "神策ROI" < 1.5 then 'weak' when "神策ROI" > 2.5 then 'strong' else 'none' end
      AS band FROM ({with_ratios(rollup('day_rows', ['SKU', 'Date']), 1.0)})""", ["SKU", "band"], day=["Date"])
add("k4_generation_flag",
    f"""SELECT "SKU", case {GEN.format(s='customlabel1')} when '2023新品' then 'new' when '老品' then 'old'
      else 'other' end AS flag FROM label""", ["SKU", "flag"])
