"""Unified daily schema and the vendor export layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Unified daily table: 13 base columns in this order, plus 3 derived ratios.
UNIFIED_COLUMNS = [
    "date", "channel", "campaign_id", "campaign_name", "campaign_type",
    "spend", "revenue", "clicks", "impressions", "conversions", "daily_budget",
    "revenue_is_estimated", "revenue_source",
]
RATIO_COLUMNS = ["roas", "cpc", "cvr"]

UNIFIED_TYPES = {
    "date": T.DateType(),
    "channel": T.StringType(),
    "campaign_id": T.StringType(),
    "campaign_name": T.StringType(),
    "campaign_type": T.StringType(),
    "spend": T.DoubleType(),
    "revenue": T.DoubleType(),
    "clicks": T.LongType(),
    "impressions": T.LongType(),
    "conversions": T.DoubleType(),
    "daily_budget": T.DoubleType(),
    "revenue_is_estimated": T.BooleanType(),
    "revenue_source": T.StringType(),
    "roas": T.DoubleType(),
    "cpc": T.DoubleType(),
    "cvr": T.DoubleType(),
}

UNIFIED_SCHEMA = T.StructType(
    [T.StructField(c, UNIFIED_TYPES[c], True) for c in UNIFIED_COLUMNS + RATIO_COLUMNS]
)

# Vendor export field → unified field.
GOOGLE_FIELDS = {
    "segments_date": "date",
    "metrics_clicks": "clicks",
    "metrics_conversions": "conversions",
    "metrics_cost_micros": "spend",
    "metrics_impressions": "impressions",
    "metrics_conversions_value": "revenue",
    "campaign_advertising_channel_type": "campaign_type",
    "campaign_budget_amount": "daily_budget",
    "campaign_id": "campaign_id",
    "campaign_name": "campaign_name",
}
BING_FIELDS = {
    "CampaignId": "campaign_id",
    "TimePeriod": "date",
    "Revenue": "revenue",
    "Spend": "spend",
    "Clicks": "clicks",
    "Impressions": "impressions",
    "Conversions": "conversions",
    "CampaignType": "campaign_type",
    "DailyBudget": "daily_budget",
    "CampaignName": "campaign_name",
}
META_FIELDS = {
    "date_start": "date",
    "conversion": "conversions",
    "campaign_id": "campaign_id",
    "campaign_name": "campaign_name",
    "spend": "spend",
    "clicks": "clicks",
    "impressions": "impressions",
    "daily_budget": "daily_budget",
}

# Constant labels per channel.
GOOGLE_CHANNEL, BING_CHANNEL, META_CHANNEL = "Google", "Bing", "Meta"
GOOGLE_REVENUE_SOURCE = "metrics_conversions_value"
BING_REVENUE_SOURCE = "Revenue"
GOOGLE_MICROS_PER_UNIT = 1_000_000
META_DEFAULT_FALLBACK_ROAS = 2.0
