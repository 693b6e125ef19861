"""Data-quality checks on the unified daily table.

Each check is its own small DataFrame (so a report can pick what it needs and
Spark plans each independently); the scalar row counts share one pass via
``count_if``. Channel-keyed results drop rows with a missing channel, as a
value count would; the leak-spend list keeps missing names as their own group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_sum, out_round, safe_ratio
from ..sources.schema import RATIO_COLUMNS, UNIFIED_COLUMNS

EXTREME_ROAS = 50.0
TOP_N = 10
DUP_KEYS = ["channel", "campaign_id", "date"]


def _leak():
    return (F.col("spend") > 0) & (F.col("revenue") == 0)


def _with_channel(df: DataFrame) -> DataFrame:
    return df.filter(F.col("channel").isNotNull())


def date_range(df: DataFrame) -> DataFrame:
    return _with_channel(df).groupBy("channel").agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def zero_revenue_campaigns(df: DataFrame) -> DataFrame:
    """Distinct campaign names with spend but no revenue (a missing name is listed once)."""
    return df.filter(_leak()).select("campaign_name").distinct()


def zero_revenue_top_spend(df: DataFrame, n: int = TOP_N) -> DataFrame:
    """Leak spend per (channel, name), largest first; rounded after ordering."""
    g = df.filter(_leak()).groupBy("channel", "campaign_name").agg(exact_sum("spend").alias("spend"))
    top = g.orderBy(F.col("spend").desc(), F.col("channel").asc_nulls_first(),
                    F.col("campaign_name").asc_nulls_first()).limit(n)
    return top.select("channel", "campaign_name", out_round("spend").alias("spend"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """(channel, campaign, date) keys that occur more than once, with their row count."""
    return (df.groupBy(*DUP_KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that belong to a duplicated key, counting every member."""
    return duplicate_keys(df).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("duplicate_rows"))


def counts(df: DataFrame) -> DataFrame:
    """All scalar row counts of the report in one pass."""
    flag = F.coalesce(F.col("revenue_is_estimated"), F.lit(False)) if "revenue_is_estimated" in df.columns \
        else F.lit(False)
    row_roas = F.try_divide(F.col("revenue"), F.col("spend"))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(_leak()).alias("zero_revenue_rows"),
        F.count_distinct(F.when(_leak(), F.col("campaign_name"))).alias("zero_revenue_campaign_count"),
        F.count_if(F.col("spend") < 0).alias("negative_spend_rows"),
        F.count_if(F.col("revenue") < 0).alias("negative_revenue_rows"),
        F.count_if(flag).alias("estimated_revenue_rows"),
        F.count_if(F.col("spend") == 0).alias("zero_spend_rows"),
        F.count_if((F.col("spend") > 0) & (row_roas > EXTREME_ROAS)).alias("extreme_roas_rows"),
    )


def record_counts(df: DataFrame) -> DataFrame:
    return _with_channel(df).groupBy("channel").agg(F.count(F.lit(1)).alias("records"))


def missing_values(df: DataFrame) -> DataFrame:
    """Missing-value count per column, only columns with at least one (one scan)."""
    cols = [c for c in UNIFIED_COLUMNS + RATIO_COLUMNS if c in df.columns]
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "missing_count")
    return long.filter(F.col("missing_count") > 0)


def observed_dates(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("channel").isNotNull() & F.col("date").isNotNull())
            .select("channel", "date").distinct())


def missing_dates(df: DataFrame) -> DataFrame:
    """Calendar days between a channel's first and last date with no row.

    Works on distinct (channel, date) pairs, so the expansion is bounded by the
    calendar length, not by the row count.
    """
    obs = observed_dates(df)
    cal = (obs.groupBy("channel").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
           .select("channel", F.explode(F.sequence("lo", "hi")).alias("date")))
    return cal.join(obs, ["channel", "date"], "left_anti").withColumnRenamed("date", "missing_date")


def missing_date_counts(df: DataFrame) -> DataFrame:
    """Count of missing days per channel (0 included) without expanding the calendar."""
    return observed_dates(df).groupBy("channel").agg(
        (F.datediff(F.max("date"), F.min("date")) + 1 - F.count(F.lit(1))).cast("long").alias("missing_dates"))


def coverage_mismatch(df: DataFrame) -> DataFrame:
    per = date_range(df)
    overall = df.agg(F.min("date").alias("g_min"), F.max("date").alias("g_max"))
    return per.crossJoin(F.broadcast(overall)).select(
        "channel",
        F.datediff("min_date", "g_min").alias("starts_after_global_min_days"),
        F.datediff("g_max", "max_date").alias("ends_before_global_max_days"),
    )


def estimated_by_channel(df: DataFrame) -> DataFrame:
    return (_with_channel(df).filter(F.coalesce(F.col("revenue_is_estimated"), F.lit(False)))
            .groupBy("channel").agg(F.count(F.lit(1)).alias("estimated_rows")))


def revenue_sources(df: DataFrame) -> DataFrame:
    """Sorted distinct source labels per channel, as a list and as text."""
    per = _with_channel(df).groupBy("channel").agg(F.sort_array(F.collect_set("revenue_source")).alias("sources"))
    return per.withColumn("sources_text", F.array_join("sources", ", "))


def zero_spend_by_channel(df: DataFrame) -> DataFrame:
    return (_with_channel(df).filter(F.col("spend") == 0)
            .groupBy("channel").agg(F.count(F.lit(1)).alias("zero_spend_rows")))


def extreme_roas_top(df: DataFrame, n: int = TOP_N) -> DataFrame:
    pos = df.filter(F.col("spend") > 0).withColumn("row_roas", F.try_divide(F.col("revenue"), F.col("spend")))
    top = pos.filter(F.col("row_roas") > EXTREME_ROAS).orderBy(
        F.col("row_roas").desc(), F.col("channel").asc_nulls_first(), F.col("campaign_name").asc_nulls_first(),
        F.col("date").asc_nulls_first(), F.col("campaign_id").asc_nulls_first(), F.col("spend").desc(),
    ).limit(n)
    return top.select(
        "channel", "campaign_name", F.date_format("date", "yyyy-MM-dd").alias("date"),
        out_round("spend").alias("spend"), out_round("revenue").alias("revenue"),
        out_round("row_roas").alias("row_roas"))


def estimated_channels(df: DataFrame) -> DataFrame:
    return (_with_channel(df).filter(F.coalesce(F.col("revenue_is_estimated"), F.lit(False)))
            .select("channel").distinct())


SCALAR_CHECKS = ["total_records", "zero_revenue_rows", "zero_revenue_campaign_count", "negative_spend_rows",
                 "negative_revenue_rows", "estimated_revenue_rows", "zero_spend_rows", "extreme_roas_rows"]


def validation_summary(df: DataFrame) -> DataFrame:
    """The whole report in long form: (check, channel, value); channel is null for overall counts.

    Three passes over the rows: one per-channel aggregate (records, zero-spend and
    estimated rows, first/last/distinct dates — coverage and gaps derive from it),
    one pass of scalar counts, and the duplicate-key aggregate.
    """
    flag = F.coalesce(F.col("revenue_is_estimated"), F.lit(False))
    per = _with_channel(df).groupBy("channel").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("spend") == 0).alias("zero_spend_rows"),
        F.count_if(flag).alias("estimated_rows"),
        F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.count_distinct("date").alias("n_dates"),
    )
    # One row per channel: the global range is a tiny aggregate of this table.
    g = per.agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"))
    per = per.crossJoin(F.broadcast(g)).select(
        "channel", "records", "zero_spend_rows", "estimated_rows",
        (F.datediff("hi", "lo") + 1 - F.col("n_dates")).alias("missing_dates"),
        F.datediff("lo", "g_lo").alias("starts_after_global_min_days"),
        F.datediff("g_hi", "hi").alias("ends_before_global_max_days"),
    )
    checks = ["records", "missing_dates", "zero_spend_rows", "estimated_rows",
              "starts_after_global_min_days", "ends_before_global_max_days"]
    long = per.select("channel", *[F.col(c).cast("long").alias(c) for c in checks]).unpivot(
        ["channel"], checks, "check", "value")
    # Value-count style checks list only channels that have such rows.
    long = long.filter(~F.col("check").isin("zero_spend_rows", "estimated_rows") | (F.col("value") > 0))
    overall = counts(df).crossJoin(duplicate_rows(df)).unpivot(
        [], SCALAR_CHECKS + ["duplicate_rows"], "check", "value").select(
        "check", F.lit(None).cast("string").alias("channel"), F.col("value").cast("long").alias("value"))
    return overall.unionByName(long.select("check", "channel", "value"))
