"""Roll-ups: look-back window, weekly series, channel KPIs, summaries.

Every roll-up is one ``groupBy().agg()``: Spark plans it as a partial
(map-side) aggregate followed by a final aggregate, so a hot channel or
campaign is pre-combined inside each task before the shuffle and never lands
as raw rows in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import exact_sum, exact_sum_nullable, out_round, safe_ratio, week_start

GRAINS = {
    "channel": ["channel"],
    "campaign_type": ["channel", "campaign_type"],
    "campaign": ["channel", "campaign_id", "campaign_name"],
}
DEFAULT_LOOKBACK_DAYS = 90


def grain_keys(grain) -> list[str]:
    if isinstance(grain, str):
        if grain not in GRAINS:
            raise ValueError(f"unknown grain {grain!r}; expected one of {sorted(GRAINS)}")
        return list(GRAINS[grain])
    return list(grain)


def keys_present(keys: list[str]) -> Column:
    """Group keys must be present (missing keys are not a group of their own)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def undated_counts() -> list[Column]:
    """Rows without a date and their money, for ``observe``."""
    no_date = F.col("date").isNull()
    return [F.count_if(no_date).alias("rows"), *[
        exact_sum(F.when(no_date, F.col(c))).alias(c) for c in ("spend", "revenue")]]


def dated(df: DataFrame, keys: list[str], undated: Observation | None = None) -> DataFrame:
    """Rows of the series ``keys``. One without a date fails, or is counted by ``undated`` and left out."""
    rows = df.filter(keys_present(keys))
    if undated is not None:
        return rows.observe(undated, *undated_counts()).filter(F.col("date").isNotNull())
    fault = F.raise_error(F.lit("row without a date; hand in an Observation to count such rows and leave them out"))
    return rows.withColumn("date", F.coalesce("date", fault.cast("date")))


def max_date(df: DataFrame) -> Column:
    """Latest date over all channels, as a scalar subquery."""
    return df.agg(F.max("date")).scalar()


def lookback(df: DataFrame, days: int = DEFAULT_LOOKBACK_DAYS, as_of: dt.date | None = None) -> DataFrame:
    """Rows with ``date >= latest date − days`` (inclusive: ``days + 1`` dates).

    With a literal ``as_of`` the bound is a constant and reaches the Parquet
    scan as a pushed filter; otherwise it comes from a one-row scalar subquery.
    """
    if as_of is not None:
        return df.filter(F.col("date") >= F.lit(as_of - dt.timedelta(days=days)))
    return df.filter(F.col("date") >= F.date_sub(max_date(df), days))


def weekly(df: DataFrame, grain="channel", undated: Observation | None = None) -> DataFrame:
    """Daily rows → weekly (Monday) sums per series + weekly ROAS; undated rows as in :func:`dated`."""
    keys = grain_keys(grain)
    rows = dated(df, keys, undated)
    out = rows.groupBy(*keys, week_start("date").alias("week")).agg(
        exact_sum("spend").alias("spend"),
        exact_sum("revenue").alias("revenue"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("clicks"),
        F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("impressions"),
        exact_sum("conversions").alias("conversions"),
    )
    return out.withColumn("roas", safe_ratio("revenue", "spend"))


def _sources_text(c: str = "revenue_source") -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), ", ")


def _row_mean(c: str) -> Column:
    return F.try_divide(exact_sum_nullable(c), F.count(c).cast("double"))


def channel_metrics(df: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                    as_of: dt.date | None = None) -> DataFrame:
    """Per-channel KPIs over the look-back window (one aggregate, no joins).

    ``avg_daily_*`` are means over rows in the window (not per calendar day).
    """
    recent = lookback(df, lookback_days, as_of).filter(F.col("channel").isNotNull())
    has_flag = "revenue_is_estimated" in df.columns
    has_source = "revenue_source" in df.columns
    est = F.count_if(F.coalesce(F.col("revenue_is_estimated"), F.lit(False))) if has_flag else F.lit(0)
    agg = recent.groupBy("channel").agg(
        exact_sum("spend").alias("total_spend"),
        exact_sum("revenue").alias("total_revenue"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("total_clicks"),
        F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("total_impressions"),
        exact_sum("conversions").alias("total_conversions"),
        _row_mean("spend").alias("avg_daily_spend"),
        _row_mean("revenue").alias("avg_daily_revenue"),
        est.cast("long").alias("estimated_revenue_rows"),
        F.count(F.lit(1)).alias("rows_in_lookback"),
        (_sources_text() if has_source else F.lit("unknown")).alias("revenue_source"),
    )
    return agg.select(
        "channel", "total_spend", "total_revenue", "total_clicks", "total_impressions",
        "total_conversions", "avg_daily_spend", "avg_daily_revenue", "estimated_revenue_rows",
        out_round(safe_ratio("total_revenue", "total_spend")).alias("roas"),
        out_round(safe_ratio("total_spend", "total_clicks")).alias("cpc"),
        out_round(safe_ratio("total_conversions", "total_clicks")).alias("cvr"),
        "rows_in_lookback",
        (F.col("estimated_revenue_rows") > 0).alias("revenue_is_estimated"),
        out_round(safe_ratio("estimated_revenue_rows", "rows_in_lookback")).alias("estimated_revenue_share"),
        "revenue_source",
    )


def lookback_rows(df: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                  as_of: dt.date | None = None) -> DataFrame:
    return (lookback(df, lookback_days, as_of).filter(F.col("channel").isNotNull())
            .groupBy("channel").agg(F.count(F.lit(1)).alias("rows")))


def historical_summary(df: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                       as_of: dt.date | None = None) -> DataFrame:
    """Per-channel totals, row means and aggregate ratios (all 2 dp) + overall date range."""
    recent = lookback(df, lookback_days, as_of).filter(F.col("channel").isNotNull())
    per = recent.groupBy("channel").agg(
        exact_sum("spend").alias("total_spend"),
        exact_sum("revenue").alias("total_revenue"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("total_clicks"),
        exact_sum("conversions").alias("total_conversions"),
        _row_mean("spend").alias("avg_daily_spend"),
        _row_mean("revenue").alias("avg_daily_revenue"),
    )
    overall = df.agg(
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("date_range"),
        F.array_join(F.sort_array(F.collect_set("channel")), ", ").alias("channels"),
    )
    out = per.select(
        "channel",
        out_round("total_spend").alias("total_spend"),
        out_round("total_revenue").alias("total_revenue"),
        "total_clicks",
        out_round("total_conversions").alias("total_conversions"),
        out_round("avg_daily_spend").alias("avg_daily_spend"),
        out_round("avg_daily_revenue").alias("avg_daily_revenue"),
        out_round(safe_ratio("total_revenue", "total_spend")).alias("aggregate_roas"),
        out_round(safe_ratio("total_spend", "total_clicks")).alias("cpc"),
        out_round(safe_ratio("total_conversions", "total_clicks")).alias("cvr"),
    )
    # One-row side: broadcast is bounded by construction.
    return out.crossJoin(F.broadcast(overall))


def campaign_history(df: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS,
                     as_of: dt.date | None = None) -> DataFrame:
    """Revenue, spend, estimated rows and source labels per (channel, name, type)."""
    keys = ["channel", "campaign_name", "campaign_type"]
    recent = lookback(df, lookback_days, as_of).filter(keys_present(keys))
    return recent.groupBy(*keys).agg(
        exact_sum("revenue").alias("historical_revenue"),
        exact_sum("spend").alias("historical_spend"),
        F.count_if(F.coalesce(F.col("revenue_is_estimated"), F.lit(False))).cast("long")
        .alias("estimated_revenue_rows"),
        _sources_text().alias("revenue_source"),
    )


def series_eligibility(weekly_df: DataFrame, keys: list[str], min_weeks: int = 4) -> DataFrame:
    """Weekly row count per series and whether it has enough history to fit."""
    return weekly_df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_weeks")).withColumn(
        "eligible", F.col("n_weeks") >= min_weeks)
