"""Vendor-export views derived from the driver's TPC-H-style tables.

``lineitem`` joined to ``supplier`` plays the role of three ad-platform
exports. Every lineitem row lands in exactly one channel (by return flag), so
queries built on these views run over the whole table:

* ``A`` → Google export, ``N`` → Bing export, ``R`` → Meta export;
* date = ship date, campaign = supplier, spend = price × discount, and so on
  (the full mapping is in ``FIXTURES.md``; the SQL oracle uses the same rules).

The supplier join is left to the optimizer: the supplier table grows with the
scale factor, so no broadcast is forced; Spark broadcasts it only while it is
under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact

# Campaign-name stems by supplier key modulo 6, campaign types by
# supplier key modulo 3, channel by return flag.
NAME_STEMS = ["Prospecting", "REMARKETING", "Retargeting DPA", "dpa", "Generic", "Brand"]
TYPE_LABELS = ["SEARCH", "SHOPPING", "VIDEO"]
NULL_NAME_MODULUS, NULL_NAME_REMAINDER = 37, 1
CHANNEL_FLAGS = {"Google": "A", "Bing": "N", "Meta": "R"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table as a lazy DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_modulo(key: Column, labels: list[str]) -> Column:
    m = key % len(labels)
    expr = F.when(m == 0, F.lit(labels[0]))
    for i, label in enumerate(labels[1:], start=1):
        expr = expr.when(m == i, F.lit(label))
    return expr


def base_rows(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Rows of one return flag (one channel); the flag filter is pushed to the lineitem scan."""
    return _base(spark, sf_dir).filter(F.col("flag") == flag).drop("flag")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join + derive the shared measures."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
        "l_returnflag")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = li.join(sup, li.l_suppkey == sup.s_suppkey, "inner")
    key = F.col("l_suppkey")
    name = F.when(key % NULL_NAME_MODULUS == NULL_NAME_REMAINDER, F.lit(None).cast("string")).otherwise(
        F.concat(_by_modulo(key, NAME_STEMS), F.lit(" | "), F.col("s_name")))
    spend = F.col("l_extendedprice") * F.col("l_discount") + F.lit(0.0)
    return j.select(
        F.col("l_returnflag").alias("flag"),
        F.to_date("l_shipdate").alias("d"),
        key.cast("string").alias("cid"),
        name.alias("cname"),
        _by_modulo(key, TYPE_LABELS).alias("ctype"),
        spend.alias("spend"),
        (spend.cast("decimal(18,6)") * F.lit(1000000)).cast("long").alias("micros"),
        F.when(F.col("l_tax") == 0, F.lit(0.0))
        .otherwise(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("l_quantity").cast("long"))
        .cast("long").alias("clicks"),
        (F.col("l_quantity") * 100 + F.col("l_linenumber")).cast("long").alias("impressions"),
        F.col("l_linenumber").cast("double").alias("conversions"),
        (F.col("l_extendedprice") / 10).alias("budget"),
        (F.col("l_extendedprice") / 100).alias("conv_value"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("meta_revenue"),
    )


def google_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base_rows(spark, sf_dir, CHANNEL_FLAGS["Google"])
    return b.select(
        F.col("d").alias("segments_date"),
        F.col("cid").alias("campaign_id"),
        F.col("cname").alias("campaign_name"),
        F.col("ctype").alias("campaign_advertising_channel_type"),
        F.col("micros").alias("metrics_cost_micros"),
        F.col("revenue").alias("metrics_conversions_value"),
        F.col("clicks").alias("metrics_clicks"),
        F.col("impressions").alias("metrics_impressions"),
        F.col("conversions").alias("metrics_conversions"),
        F.col("budget").alias("campaign_budget_amount"),
    )


def bing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base_rows(spark, sf_dir, CHANNEL_FLAGS["Bing"])
    return b.select(
        F.col("d").alias("TimePeriod"),
        F.col("cid").alias("CampaignId"),
        F.col("cname").alias("CampaignName"),
        F.col("ctype").alias("CampaignType"),
        F.col("spend").alias("Spend"),
        F.col("revenue").alias("Revenue"),
        F.col("clicks").alias("Clicks"),
        F.col("impressions").alias("Impressions"),
        F.col("conversions").alias("Conversions"),
        F.col("budget").alias("DailyBudget"),
    )


def meta_raw(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    """Meta export; ``variant`` adds ``revenue`` or ``conversion_value`` fields."""
    b = base_rows(spark, sf_dir, CHANNEL_FLAGS["Meta"])
    cols = [
        F.col("d").alias("date_start"),
        F.col("cid").alias("campaign_id"),
        F.col("cname").alias("campaign_name"),
        F.col("spend").alias("spend"),
        F.col("clicks").alias("clicks"),
        F.col("impressions").alias("impressions"),
        F.col("conversions").alias("conversion"),
        F.lit(None).cast("double").alias("daily_budget"),
    ]
    if variant == "revenue":
        cols.append(F.col("meta_revenue").alias("revenue"))
    elif variant == "conversion_value":
        cols.append(F.col("conv_value").alias("conversion_value"))
    elif variant != "plain":
        raise ValueError(f"unknown Meta variant {variant!r}")
    return b.select(*cols)


# Faults planted in the dirty Bing export, by supplier key: (modulus, remainder, field, text).
DIRTY = [
    (11, 3, "TimePeriod", "not a date"), (13, 5, "Clicks", "3.5"), (17, 2, "Spend", "NA"), (19, 7, "Revenue", "12,50"),
    (23, 4, "Impressions", "many"), (29, 6, "TimePeriod", ""), (31, 9, "Conversions", "n/a"),
]


def dirty_bing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Bing export as text with missing tokens and unreadable values planted in the rows of some suppliers."""
    raw = bing_raw(spark, sf_dir)
    key = F.col("CampaignId").cast("long")
    text = {f.name: F.col(f.name).cast("string") for f in raw.schema.fields}
    for modulus, remainder, field, value in DIRTY:
        text[field] = F.when(key % modulus == remainder, F.lit(value)).otherwise(text[field])
    return raw.select(*[c.alias(name) for name, c in text.items()])


def raw_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "Google": google_raw(spark, sf_dir),
        "Bing": bing_raw(spark, sf_dir),
        "Meta": meta_raw(spark, sf_dir),
    }
