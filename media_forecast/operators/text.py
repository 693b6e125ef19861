"""Narrative context rows: one text block per scenario, built from aggregates only.

Every input is already aggregated (one row per channel, per scenario or a
single report row), so the text is assembled with ``format_string`` /
``concat_ws`` over small frames; raw daily rows never reach a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kpis, quality

TOP_LEAKS_IN_TEXT = 5


def money(c) -> Column:
    return F.format_string("$%,.0f", F.col(c) if isinstance(c, str) else c)


def ratio_text(c) -> Column:
    return F.format_string("%.2fx", F.col(c) if isinstance(c, str) else c)


def _lines(df: DataFrame, order, line: Column, sep: str = "\n") -> DataFrame:
    """One-row frame with the per-row lines joined in ``order`` (inputs are per-channel sized)."""
    key = F.col(order) if isinstance(order, str) else order
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"),
                                                                                    line.alias("v")))),
                                           lambda s: s["v"]), sep).alias("text"))


def history_block(df: DataFrame) -> DataFrame:
    hs = kpis.historical_summary(df)
    line = F.format_string("  %s: spend %s, revenue %s, ROAS %s, CPC %.2f, CVR %.2f, mean row spend %s",
                           F.col("channel"), money("total_spend"), money("total_revenue"),
                           ratio_text("aggregate_roas"), F.col("cpc"), F.col("cvr"), money("avg_daily_spend"))
    table = _lines(hs, "channel", line).withColumnRenamed("text", "channel_table")
    head = hs.select("date_range", "channels").limit(1)
    return head.crossJoin(table)


def quality_block(df: DataFrame) -> DataFrame:
    c = quality.counts(df)
    dups = quality.duplicate_rows(df)
    gaps = _lines(quality.missing_date_counts(df), "channel",
                  F.format_string("%s=%d", F.col("channel"), F.col("missing_dates")), ", ").withColumnRenamed(
        "text", "gaps")
    est = _lines(quality.estimated_by_channel(df), "channel",
                 F.format_string("%s=%d", F.col("channel"), F.col("estimated_rows")), ", ").withColumnRenamed(
        "text", "estimated")
    src = _lines(quality.revenue_sources(df), "channel",
                 F.format_string("%s=[%s]", F.col("channel"), F.col("sources_text")), ", ").withColumnRenamed(
        "text", "sources")
    top = quality.zero_revenue_top_spend(df, TOP_LEAKS_IN_TEXT)
    order = F.struct(-F.col("spend"), F.col("channel"), F.col("campaign_name"))
    leaks = _lines(top, order, F.format_string("    %s / %s: %s spent with no revenue", F.col("channel"),
                                                F.coalesce(F.col("campaign_name"), F.lit("(unnamed)")),
                                                money("spend"))).withColumnRenamed("text", "leaks")
    one = c.crossJoin(dups).crossJoin(gaps).crossJoin(est).crossJoin(src).crossJoin(leaks)
    text = F.concat_ws(
        "\n",
        F.format_string("  rows sharing a campaign/day key: %d", F.col("duplicate_rows")),
        F.format_string("  campaigns spending without revenue: %d (%d rows)", F.col("zero_revenue_campaign_count"),
                        F.col("zero_revenue_rows")),
        F.format_string("  rows with zero spend: %d", F.col("zero_spend_rows")),
        F.format_string("  rows with ROAS above 50: %d", F.col("extreme_roas_rows")),
        F.concat(F.lit("  calendar gaps by channel: "), F.col("gaps")),
        F.concat(F.lit("  estimated-revenue rows by channel: "), F.coalesce(F.col("estimated"), F.lit(""))),
        F.concat(F.lit("  revenue sources: "), F.col("sources")),
        F.when(F.length("leaks") > 0, F.concat(F.lit("  largest spend without revenue:\n"), F.col("leaks"))),
    )
    return one.select(text.alias("quality_text"))


def forecast_block(forecast: DataFrame, blend: DataFrame) -> DataFrame:
    line = F.format_string("  %s: budget %s -> revenue %s / %s / %s (ROAS %s / %s / %s)%s",
                           F.col("channel"), money("planned_spend"), money("revenue_low"), money("revenue_median"),
                           money("revenue_high"), ratio_text("roas_low"), ratio_text("roas_median"),
                           ratio_text("roas_high"),
                           F.when(F.col("status") != "ok", F.concat(F.lit(" ["), F.col("status"), F.lit("]")))
                           .otherwise(F.lit("")))
    per = forecast.groupBy("scenario_id").agg(
        F.max("horizon_days").alias("horizon_days"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("channel").alias("k"), line.alias("v")))),
                                 lambda s: s["v"]), "\n").alias("channel_text"))
    b = blend.select("scenario_id", F.format_string(
        "  total budget %s -> revenue %s / %s / %s, ROAS %s to %s", money("total_spend"), money("revenue_low"),
        money("revenue_median"), money("revenue_high"), ratio_text("roas_low"), ratio_text("roas_high"))
        .alias("blended_text"))
    return per.join(b, "scenario_id", "inner")


def prompt_rows(df: DataFrame, forecast: DataFrame, blend: DataFrame) -> DataFrame:
    """(scenario_id, horizon_days, prompt) — the context handed to a narrative writer."""
    hist = history_block(df)
    dq = quality_block(df)
    fc = forecast_block(forecast, blend)
    rows = fc.crossJoin(F.broadcast(hist)).crossJoin(F.broadcast(dq))
    prompt = F.concat_ws(
        "\n",
        F.format_string("Context for a %d-day revenue outlook across paid channels.", F.col("horizon_days")),
        F.concat(F.lit("History window: "), F.col("date_range"), F.lit("; channels: "), F.col("channels")),
        F.lit("Last 90 days by channel:"), F.col("channel_table"),
        F.lit("Data checks:"), F.col("quality_text"),
        F.lit("Planned budgets and modelled outcomes (low / median / high):"), F.col("channel_text"),
        F.lit("All channels together:"), F.col("blended_text"),
        F.lit("Ranges combine a trend model and a quantile model; they are planning bands, not guarantees. "
              "Channels whose revenue is estimated rather than observed should be read as assumptions."),
    )
    return rows.select("scenario_id", "horizon_days", prompt.alias("prompt"))
