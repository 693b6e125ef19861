"""Campaign-level allocation of a channel forecast.

Each campaign (channel, name, type) gets its share of the channel's median
forecast: by revenue over the look-back when the channel has revenue, else by
spend, else zero. Channels without a forecast keep a missing allocation.
Channel totals are pre-aggregated sums joined back to the campaigns, so no
task holds all campaigns of a channel. The forecast side has one row per
scenario and channel; every scenario is allocated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from .kpis import DEFAULT_LOOKBACK_DAYS, campaign_history

# Allocation basis labels.
BASIS_REVENUE, BASIS_SPEND, BASIS_NONE = "Revenue share", "Spend share", "No spend/revenue"


def allocate(df: DataFrame, forecast: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> DataFrame:
    """``forecast``: one row per ``scenario_id`` (if it has that column) and ``channel`` with ``revenue_median``."""
    scenario = ["scenario_id"] if "scenario_id" in forecast.columns else []
    camp = campaign_history(df, lookback_days)
    totals = camp.groupBy("channel").agg(
        F.sum(exact("historical_revenue")).cast("double").alias("ch_revenue"),
        F.sum(exact("historical_spend")).cast("double").alias("ch_spend"),
    )
    camp = camp.join(totals, "channel")
    fc = forecast.select(*scenario, "channel", F.col("revenue_median").alias("ch_forecast"), F.lit(True).alias("has_fc"))
    j = camp.join(fc, "channel", "left")
    has = F.col("has_fc").isNotNull()
    by_rev = F.col("ch_revenue") > 0
    by_spend = F.col("ch_spend") > 0
    value = (F.when(~has, F.lit(None).cast("double"))
             .when(by_rev, F.col("historical_revenue") / F.col("ch_revenue") * F.col("ch_forecast"))
             .when(by_spend, F.col("historical_spend") / F.col("ch_spend") * F.col("ch_forecast"))
             .otherwise(F.lit(0.0)))
    basis = (F.when(~has, F.lit(None).cast("string")).when(by_rev, F.lit(BASIS_REVENUE))
             .when(by_spend, F.lit(BASIS_SPEND)).otherwise(F.lit(BASIS_NONE)))
    return j.select(
        *scenario, "channel", "campaign_name", "campaign_type", "historical_spend", "historical_revenue",
        value.alias("forecast_revenue"), basis.alias("allocation_basis"),
        (F.col("estimated_revenue_rows") > 0).alias("revenue_is_estimated"), "revenue_source",
    )


def ranked(allocation: DataFrame) -> DataFrame:
    """By scenario, largest forecast first (ties by channel, campaign)."""
    scenario = ["scenario_id"] if "scenario_id" in allocation.columns else []
    return allocation.orderBy(*scenario, F.col("forecast_revenue").desc_nulls_last(), "channel", "campaign_name", "campaign_type")
