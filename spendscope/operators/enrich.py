"""Joins of ads facts with products and sensor facts.

Two forms of the same result:

* ``enrich`` and ``enrich_campaign`` give every row of the left joins, repeats
  included.
* ``fold_enriched`` gives one row per ads row and distinct product attributes,
  with every measure multiplied by the number of joined rows it stands for.
  Sums over it equal sums over the full form, but no join in it emits the
  pairs of a key: dimensions and sensor rows are counted or added up per key
  (with map-side partial aggregation) first. A key that holds a large share of
  a table is therefore one row by the time it is joined.

In both forms the index and the labels are joined with each other first, so
that facts meet products in one join. No join carries a broadcast hint, as the
product tables grow with the catalogue, and no shuffle is asked for by hand
(but campaign facts are dealt by the campaign keys while they merge): adaptive execution sees the true sizes, broadcasts what is small and splits a
SKU that holds a large share of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spendscope import names as n
from spendscope.functions.text import listing_generation
from spendscope.operators.cleaning import label_generation, normalise_sku
from spendscope.operators.rollup import to_ends, total
from spendscope.sources.keys import Keys, restrict


def normalise_index(spu_index: DataFrame) -> DataFrame:
    """SKU to SPU index with normalised SKUs; entries without a SKU match nothing."""
    return normalise_sku(spu_index.select("SKU", "SPU").where(F.col("SKU").isNotNull()))


def only_skus_of(spu_index: DataFrame, spus: Keys) -> DataFrame:
    """SKUs of the chosen SPUs, once each, in a normalised index."""
    return restrict(spu_index, "SPU", spus).select("SKU").distinct()


# -- full form --------------------------------------------------------------


def attach_spu(facts: DataFrame, spu_index: DataFrame) -> DataFrame:
    return facts.join(spu_index.select("SKU", "SPU"), "SKU", "left")


def attach_label(facts: DataFrame, label: DataFrame, attributes: Sequence[str] = (n.PRICE,)) -> DataFrame:
    """Listing generation and further label columns; unlabelled SKUs are old."""
    columns = ["SKU", "customlabel1", *attributes]
    return label_generation(facts.join(label.select(*columns), "SKU", "left"))


def products_of(
    spu_index: DataFrame, label: DataFrame, attributes: Sequence[str] = (n.PRICE,), of_index: Sequence[str] = ("SPU",)
) -> DataFrame:
    """All pairs of index and label rows of a SKU, either side possibly missing.

    A left join with it equals a left join with the index, then with the labels.
    """
    wanted = label.select("SKU", "customlabel1", *attributes)
    return spu_index.select("SKU", *of_index).join(wanted, "SKU", "full")


def attach_products(facts: DataFrame, products: DataFrame) -> DataFrame:
    return label_generation(facts.join(products, "SKU", "left"))


def counted_products(spu_index: DataFrame, label: DataFrame, attributes: Sequence[str] = (n.PRICE,)) -> DataFrame:
    """``products_of`` with ``product_rows``, the number of product rows of the SKU.

    Each table counts its own rows per SKU before the two meet. The join's key is
    then one that no shuffle below has, so the facts' join gets a shuffle of its own
    on either side, which adaptive execution can split.
    """
    def own(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.count("*").over(Window.partitionBy("SKU")))

    both = products_of(own(spu_index, "spu_rows"), own(label, "label_rows"), (*attributes, "label_rows"), ("SPU", "spu_rows"))
    return both.withColumn("product_rows", F.coalesce("spu_rows", F.lit(1)) * F.coalesce("label_rows", F.lit(1))).drop("spu_rows", "label_rows")


def repeat_by_products(sensor: DataFrame, spu_index: DataFrame, label: DataFrame) -> DataFrame:
    """Sensor rows once per product row of their SKU (no column is added)."""
    return sensor.join(products_of(spu_index, label).select("SKU"), "SKU", "left")


def enrich(
    ads: DataFrame, label: DataFrame, sensor: DataFrame, spu_index: DataFrame, period: str = "Date"
) -> DataFrame:
    """Cleaned ads with SPU, generation, price and sensor measures.

    Sensor rows repeat per product row of their SKU. They are joined once, as
    they are, and the joined row is repeated afterwards, so that products are
    built and sensor rows shuffled only once.
    """
    rows = attach_products(ads, counted_products(spu_index, label))
    visits = sensor.select("SKU", period, *n.SENSOR_MEASURES, F.lit(True).alias("visited"))
    joined = rows.join(visits, ["SKU", period], "left")
    times = F.when(F.col("visited"), F.coalesce("product_rows", F.lit(1))).otherwise(F.lit(1))
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return repeated.drop("copy", "visited", "product_rows")


CAMPAIGN_KEYS = ("Date", "Campaign", "Campaign ID", "SKU")
#: The order in which sensor rows are grouped; facts dealt in the same one meet them without another shuffle.
#: The campaign comes first: sorted rows then have it in common with their neighbours, and the next shuffle packs them tighter.
CAMPAIGN_DEAL = ("Campaign", "Campaign ID", "SKU", "Date")
#: Columns that are alike in the rows of a SKU.
PRODUCT_COLUMNS = ("SKU", n.PT3, "SPU", n.GENERATION, n.PRICE, "image")


def fill_missing(df: DataFrame) -> DataFrame:
    """Zero in every column: 0 in numbers, '0' in text."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return df.fillna(0.0).fillna("0", subset=texts)


def enrich_campaign(
    ads: DataFrame, label: DataFrame, sensor: DataFrame, spu_index: DataFrame
) -> DataFrame:
    """Cleaned campaign ads with products and sensor measures, filled.

    Sensor rows are joined first: facts that were dealt by the campaign keys when they merged stay where they are.
    """
    visits = sensor.select(*CAMPAIGN_KEYS, *n.CAMPAIGN_SENSOR_MEASURES)
    met = to_ends(ads.join(visits, list(CAMPAIGN_DEAL), "left"), ("Campaign", "Campaign ID", "SKU"), (n.PT3,))
    joined = attach_products(met, products_of(spu_index, label, (n.PRICE, "imagelink")))
    rest = [x for x in ads.columns if x not in CAMPAIGN_KEYS]
    shown = joined.withColumnRenamed("imagelink", "image").select(
        *[f"`{x}`" for x in (*CAMPAIGN_KEYS, *rest, "SPU", n.GENERATION, n.PRICE, "image", *n.CAMPAIGN_SENSOR_MEASURES)])
    return fill_missing(shown)


def presented(rows: DataFrame) -> DataFrame:
    """Campaign rows in the order in which they are shown: by SKU, the last day first."""
    ordered = to_ends(rows, PRODUCT_COLUMNS, ["Campaign"]).orderBy(F.asc_nulls_last("SKU"), F.desc_nulls_last("Date"))
    return ordered.select(*[f"`{x}`" for x in rows.columns])


# -- folded form ------------------------------------------------------------


def count_copies(dimension: DataFrame, attributes: Sequence[str], prefix: str) -> DataFrame:
    """Distinct (SKU, attributes) with how many rows each stands for
    (``<prefix>_copies``) and how many rows its SKU has (``<prefix>_rows``)."""
    copies, rows = f"{prefix}_copies", f"{prefix}_rows"
    counted = (
        dimension.where(F.col("SKU").isNotNull())
        .groupBy("SKU", *attributes)
        .agg(F.count("*").cast("double").alias(copies))
    )
    if not attributes:
        return counted.withColumn(rows, F.col(copies))
    return counted.withColumn(rows, F.sum(copies).over(Window.partitionBy("SKU")))


def add_up_sensor(sensor: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sensor sums and row counts per join key."""
    return sensor.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in measures], F.count("*").cast("double").alias("sensor_rows")
    )


def _or_one(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(1.0))


def fold_enriched(
    ads: DataFrame,
    label: DataFrame,
    sensor: DataFrame,
    spu_index: DataFrame,
    keys: Sequence[str] = ("SKU", "Date"),
    ads_measures: Sequence[str] = n.ADS_MEASURES,
    sensor_measures: Sequence[str] = n.SENSOR_MEASURES,
    generation: bool = False,
    attributes: Sequence[str] = (),
    sensor_by_products: bool = True,
    spus: Keys | None = None,
    ads_count: str | None = None,
    sensor_first: bool = False,
) -> DataFrame:
    """Folded form of the joins; see the module text.

    ``ads_count`` names a column that tells how many ads rows a given one is
    the sum of; without it, each is one. ``sensor_first`` joins sensor rows before
    products: for ads rows that are dealt by ``keys`` already, which then stay
    where they are, and sums by SKU and more follow the products' join without a
    shuffle.

    ``generation`` and ``attributes`` name what is needed of the label table;
    without any it only counts. ``sensor_by_products`` tells whether sensor
    rows, too, repeat per product row. ``spus`` keeps the given SPUs only.
    """
    label_columns = list(attributes)
    if generation:
        label = label.withColumn("generation", listing_generation(F.col("customlabel1")))
        label_columns.append("generation")
    products = count_copies(spu_index, ["SPU"], "spu").join(
        count_copies(label, label_columns, "label"), "SKU", "full"
    )
    if spus is not None:
        products = restrict(products, "SPU", spus)
    kind, visits = "left" if spus is None else "inner", add_up_sensor(sensor, keys, sensor_measures)
    if sensor_first:
        rows = ads.join(visits, list(keys), "left").join(products, "SKU", kind)
    else:
        rows = ads.join(products, "SKU", kind).join(visits, list(keys), "left")

    ads_rows = _or_one("spu_copies") * _or_one("label_copies")
    per_sensor = _or_one("spu_rows") * _or_one("label_rows") if sensor_by_products else F.lit(1.0)
    matched = F.coalesce(F.col("sensor_rows") * per_sensor, F.lit(1.0))
    kept = [c for c in ads.columns if c not in ads_measures and c != ads_count]
    each = F.col(ads_count) if ads_count else F.lit(1.0)
    return rows.select(
        *[f"`{c}`" for c in kept],
        "SPU",
        *attributes,
        *([F.coalesce("generation", F.lit(n.OLD_LISTING)).alias(n.GENERATION)] if generation else []),
        *[(F.col(m) * ads_rows * matched).alias(m) for m in ads_measures],
        *[(F.col(m) * each * ads_rows * per_sensor).alias(m) for m in sensor_measures],
        (each * ads_rows * matched).alias("joined_rows"),
    )
