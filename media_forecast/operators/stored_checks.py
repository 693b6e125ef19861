"""Quality checks kept as sums beside the data, and the reports made from them.

``measure`` turns daily rows into one row per month, channel and campaign
name: counts, first and last date, and the days that have rows as a mask of
31 bits. All of these merge (sums, min, max, bitwise or), so a report over any
months reads this small table alone, and a month that is delivered again
replaces its own rows of it. Reports have the columns of their namesakes in
:mod:`quality`, which count the daily rows themselves.

Rows without a date are under the month ``undated``; missing channels and
campaign names are groups of their own. An empty table gives zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import RATIO_COLUMNS, UNIFIED_COLUMNS
from . import quality

UNDATED = "undated"
KEYS = ["month", "channel", "campaign_name"]
COUNTS = ["total_records", "zero_revenue_rows", "negative_spend_rows", "negative_revenue_rows",
          "estimated_revenue_rows", "zero_spend_rows", "extreme_roas_rows"]
MISSING = "missing_"


def month_of(date="date") -> Column:
    """``yyyy-MM`` of a date, ``undated`` where there is none."""
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNDATED))


def measure(df: DataFrame) -> DataFrame:
    """Daily rows to mergeable sums per month, channel and campaign name: one aggregate, pre-combined in each task."""
    columns = [c for c in UNIFIED_COLUMNS + RATIO_COLUMNS if c in df.columns]
    spend, revenue = F.col("spend"), F.col("revenue")
    flag = F.coalesce(F.col("revenue_is_estimated"), F.lit(False))
    day = F.expr("shiftleft(1, day(date) - 1)")
    return df.groupBy(month_of().alias("month"), "channel", "campaign_name").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if((spend > 0) & (revenue == 0)).alias("zero_revenue_rows"),
        F.count_if(spend < 0).alias("negative_spend_rows"),
        F.count_if(revenue < 0).alias("negative_revenue_rows"),
        F.count_if(flag).alias("estimated_revenue_rows"),
        F.count_if(spend == 0).alias("zero_spend_rows"),
        F.count_if((spend > 0) & (F.try_divide(revenue, spend) > quality.EXTREME_ROAS)).alias("extreme_roas_rows"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.bit_or(day).alias("days"),
        *[F.count_if(F.col(c).isNull()).alias(MISSING + c) for c in columns],
    )


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def counts(checks: DataFrame) -> DataFrame:
    """As :func:`quality.counts`."""
    names = F.count_distinct(F.when(F.col("zero_revenue_rows") > 0, F.col("campaign_name")))
    totals = checks.agg(*[_total(c).alias(c) for c in COUNTS], names.alias("zero_revenue_campaign_count"))
    return totals.select(*quality.SCALAR_CHECKS)


def record_counts(checks: DataFrame) -> DataFrame:
    """As :func:`quality.record_counts`."""
    return checks.where("channel IS NOT NULL").groupBy("channel").agg(_total("total_records").alias("records"))


def missing_values(checks: DataFrame) -> DataFrame:
    """As :func:`quality.missing_values`."""
    columns = [c for c in checks.columns if c.startswith(MISSING)]
    wide = checks.agg(*[_total(c).alias(c.removeprefix(MISSING)) for c in columns])
    long = wide.unpivot([], wide.columns, "column_name", "missing_count")
    return long.where("missing_count > 0")


def coverage(checks: DataFrame) -> DataFrame:
    """Per channel its first and last date, the calendar days between them without a row, and its distance in days from
    the first and last date of all channels (rows without a channel included)."""
    monthly = checks.groupBy("month", "channel").agg(
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"), F.bit_or("days").alias("days"))
    per = monthly.groupBy("channel").agg(
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
        F.sum(F.bit_count("days")).alias("n_days"))
    # One row, from one row per channel.
    overall = per.agg(F.min("min_date").alias("g_min"), F.max("max_date").alias("g_max"))
    return per.where("channel IS NOT NULL").crossJoin(F.broadcast(overall)).select(
        "channel", "min_date", "max_date",
        (F.datediff("max_date", "min_date") + 1 - F.col("n_days")).cast("long").alias("missing_dates"),
        F.datediff("min_date", "g_min").alias("starts_after_global_min_days"),
        F.datediff("g_max", "max_date").alias("ends_before_global_max_days"),
    )
