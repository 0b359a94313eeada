"""Small hand-made tables. Each builder fills what a test leaves out."""

from datetime import date

from spendscope import names as n, schemas as s

DAY = date(2023, 6, 1)
HOME = 569301767
MAIN = 9174985


def frame(spark, schema, rows, **defaults):
    fields = schema.fieldNames()
    unknown = {k for r in rows for k in r} - set(fields)
    assert not unknown, unknown
    return spark.createDataFrame([tuple((defaults | r).get(f) for f in fields) for r in rows], schema)


def ads(spark, *rows, monthly=False):
    schema = s.ADS_MONTHLY if monthly else s.ADS_DAILY
    base = {"SKU": "A", "Currency": "USD", n.PT3: "sofa", "Country": "US", "MC ID": MAIN,
            "impression": 100.0, "cost": 10.0, "click": 5.0, "conversions": 1.0, "ads value": 20.0}
    return frame(spark, schema, rows, **base, **{"Month" if monthly else "Date": DAY})


def ads_sku(spark, *rows):
    base = {"SKU": "A", "Currency": "USD", n.PT1: "p1", n.PT2: "p2", n.PT3: "sofa", "Country": "US", "MC ID": MAIN,
            "customlabel1": "2022", "customlabel2": "x", "customlabel4": "y", "Date": DAY,
            "impression": 100.0, "cost": 10.0, "click": 5.0, "conversions": 1.0, "ads value": 20.0}
    return frame(spark, s.ADS_SKU_DAILY, rows, **base)


def ads_campaign(spark, *rows):
    base = {"Campaign": "c", "Campaign ID": 1, "SKU": "A", "currency": "USD", n.PT3: "sofa", "Country": "US",
            "MC ID": MAIN, "Date": DAY, "Impression": 100.0, "cost": 10.0, "clicks": 5.0, "conversion": 1.0,
            "value": 20.0}
    return frame(spark, s.ADS_CAMPAIGN_DAILY, rows, **base)


def sensor(spark, *rows, monthly=False):
    schema = s.SENSOR_MONTHLY if monthly else s.SENSOR_DAILY
    base = {"SKU": "A", "Sale": 1.0, "GMV": 50.0, "AddtoCart": 2.0, "UV": 10.0}
    return frame(spark, schema, rows, **base, **{"Month" if monthly else "Date": DAY})


def sensor_campaign(spark, *rows):
    base = {"SKU": "A", "Campaign": "c", "Campaign ID": 1, "Date": DAY, "saleuser": 1.0, "sale": 2.0, "GMV": 50.0,
            "AddtoCart": 2.0, "UV": 10.0}
    return frame(spark, s.SENSOR_CAMPAIGN_DAILY, rows, **base)


def index(spark, *pairs):
    return frame(spark, s.SPU_INDEX, [{"SKU": sku, "SPU": spu} for sku, spu in pairs])


def label(spark, *rows):
    base = {"SKU": "A", "customlabel1": "2022", "imagelink": "img", n.PRICE: 9.0}
    return frame(spark, s.PRODUCT_LABEL, rows, **base)


def records(df, *columns):
    picked = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
