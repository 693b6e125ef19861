"""Budget scenarios: band combination, per-channel results, blended totals, risk.

A scenario table ``(scenario_id, <series keys>, planned_spend, horizon_days)``
of any size is scored against fitted models with joins and column arithmetic;
nothing loops on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact, exact_sum, out_round
from . import models

MIN_SPREAD = 0.15  # fixed value: minimum half-width of the combined band
# Per-channel caps (max downside, max upside) in scenario scoring.
BAND_CAPS = {"Google": (0.35, 0.45)}
# Default budget inputs and planning horizons.
DEFAULT_BUDGETS = {"Google": 50000.0, "Bing": 10000.0, "Meta": 30000.0}
HORIZONS = (30, 60, 90)
DEFAULT_HORIZON = 60
UNCERTAINTY_LEVELS = ((40.0, "HIGH"), (20.0, "MODERATE"))  # fixed values: > 40 %, > 20 %, else LOW
ROAS_ALERTS = ((1.0, "below_break_even"), (2.0, "below_target"))  # fixed values: < 1, < 2, else healthy

SCENARIO_SCHEMA = T.StructType([
    T.StructField("scenario_id", T.IntegerType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("planned_spend", T.DoubleType(), False),
    T.StructField("horizon_days", T.IntegerType(), False),
])


def default_scenario_rows() -> list[tuple[int, str, float, int]]:
    """Default budgets at each horizon, one with a zero budget, one with an unknown channel."""
    rows = []
    for sid, h in enumerate(HORIZONS, start=1):
        rows += [(sid, ch, amt, h) for ch, amt in DEFAULT_BUDGETS.items()]
    rows += [(4, "Google", 50000.0, DEFAULT_HORIZON), (4, "Bing", 10000.0, DEFAULT_HORIZON),
             (4, "Meta", 0.0, DEFAULT_HORIZON)]
    rows += [(5, "Google", 50000.0, DEFAULT_HORIZON), (5, "TikTok", 5000.0, DEFAULT_HORIZON)]
    return rows


def default_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_scenario_rows(), SCENARIO_SCHEMA)


def _cap(channel: Column, idx: int) -> Column:
    expr = None
    for ch, caps in BAND_CAPS.items():
        expr = F.when(channel == ch, F.lit(caps[idx])) if expr is None else expr.when(channel == ch, F.lit(caps[idx]))
    return expr if expr is not None else F.lit(None).cast("double")


def combine_bands(p_low: Column, p_mid: Column, p_high: Column, q_low: Column, q_mid: Column, q_high: Column,
                  min_spread: float = MIN_SPREAD, max_downside: Column | None = None,
                  max_upside: Column | None = None) -> dict[str, Column]:
    """Trend-model median with the quantile model's relative spread (2 dp).

    ``min_spread`` widens a too-narrow quantile band; optional caps bound the
    band relative to the median.
    """
    down, up = 1.0 - min_spread, 1.0 + min_spread
    q_ok = q_mid > 0
    low_pct = F.when(q_ok, F.least(q_low / q_mid, F.lit(down))).otherwise(F.lit(down))
    high_pct = F.when(q_ok, F.greatest(q_high / q_mid, F.lit(up))).otherwise(F.lit(up))
    mid = p_mid
    low = F.least(p_low, mid * low_pct)
    high = F.greatest(p_high, mid * high_pct)
    low = F.when(low > mid, mid * F.lit(down)).otherwise(low)
    high = F.when(high < mid, mid * F.lit(up)).otherwise(high)
    if max_downside is not None:
        low = F.when(max_downside.isNotNull(), F.greatest(low, mid * (F.lit(1.0) - max_downside))).otherwise(low)
    if max_upside is not None:
        high = F.when(max_upside.isNotNull(), F.least(high, mid * (F.lit(1.0) + max_upside))).otherwise(high)
    return {"revenue_low": out_round(low), "revenue_median": out_round(mid), "revenue_high": out_round(high)}


def _roas(rev: str) -> Column:
    return F.when(F.col("planned_spend") != 0, out_round(F.col(rev) / F.col("planned_spend"))).otherwise(F.lit(0.0))


def finalize(scored: DataFrame, keys: list[str], caps: bool = True) -> DataFrame:
    """Combine p_*/q_* model outputs into published rows, zeroing rows whose
    ``status`` is not ``ok``; adds ROAS columns."""
    chan = F.col("channel") if "channel" in keys else F.lit(None).cast("string")
    comb = combine_bands(F.col("p_low"), F.col("p_median"), F.col("p_high"),
                         F.col("q_low"), F.col("q_median"), F.col("q_high"),
                         max_downside=_cap(chan, 0) if caps else None, max_upside=_cap(chan, 1) if caps else None)
    ok = F.col("status") == "ok"
    out = scored.select(
        "scenario_id", *keys, "planned_spend", "horizon_days", "status",
        *[F.when(ok, c).otherwise(F.lit(0.0)).alias(name) for name, c in comb.items()],
    )
    return out.select("*", _roas("revenue_low").alias("roas_low"), _roas("revenue_median").alias("roas_median"),
                      _roas("revenue_high").alias("roas_high"))


def history_status(has_model: Column, eligible: Column) -> Column:
    return (F.when(~has_model, F.lit("no_history"))
            .when(~eligible, F.lit("insufficient_history"))
            .when(F.col("planned_spend") <= 0, F.lit("no_spend")).otherwise(F.lit("ok")))


def scenario_forecast(fit: DataFrame, scenarios: DataFrame, keys: list[str] | None = None,
                      caps: bool = True) -> DataFrame:
    """Per (scenario, series) low / median / high revenue and ROAS (closed-form models).

    A series without a fitted model, with too little history or with no
    planned spend gets an all-zero row and a ``status`` saying why.
    """
    keys = keys or ["channel"]
    scored = models.score_horizon(fit, keys, scenarios)
    scored = scored.withColumn("status", history_status(F.col("intercept").isNotNull(),
                                                        F.coalesce(F.col("eligible"), F.lit(False))))
    return finalize(scored, keys, caps)


def blended(forecast: DataFrame) -> DataFrame:
    """Per scenario: sums of channel results; ROAS over all planned spend."""
    g = forecast.groupBy("scenario_id").agg(
        exact_sum("planned_spend").alias("total_spend"),
        out_round(exact_sum("revenue_low")).alias("revenue_low"),
        out_round(exact_sum("revenue_median")).alias("revenue_median"),
        out_round(exact_sum("revenue_high")).alias("revenue_high"),
    )

    def roas(c):
        return F.when(F.col("total_spend") != 0, out_round(F.col(c) / F.col("total_spend"))).otherwise(F.lit(0.0))
    return g.select("*", roas("revenue_low").alias("roas_low"), roas("revenue_median").alias("roas_median"),
                    roas("revenue_high").alias("roas_high"))


def risk_uncertainty(blend: DataFrame) -> DataFrame:
    pct = F.when(F.col("revenue_median") > 0,
                 (F.col("revenue_high") - F.col("revenue_low")) / F.col("revenue_median") * F.lit(100.0)
                 ).otherwise(F.lit(0.0))
    level = None
    for bound, label in UNCERTAINTY_LEVELS:
        level = F.when(pct > bound, F.lit(label)) if level is None else level.when(pct > bound, F.lit(label))
    return blend.select("scenario_id", out_round(pct).alias("uncertainty_pct"),
                        level.otherwise(F.lit("LOW")).alias("uncertainty_level"))


def channel_alerts(forecast: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["channel"]
    alert = None
    for bound, label in ROAS_ALERTS:
        c = F.col("roas_low") < bound
        alert = F.when(c, F.lit(label)) if alert is None else alert.when(c, F.lit(label))
    return forecast.select("scenario_id", *keys, "roas_low", alert.otherwise(F.lit("healthy")).alias("alert"))


def forecast_range(forecast: DataFrame, blend: DataFrame) -> DataFrame:
    """Range-chart rows: low, band (high − low), median per channel plus a blended row."""
    def rows(df, label):
        return df.select("scenario_id", label, "revenue_low",
                         out_round(F.col("revenue_high") - F.col("revenue_low")).alias("band"), "revenue_median")
    return rows(forecast, F.col("channel")).unionByName(rows(blend, F.lit("blended").alias("channel")))


def roas_long(forecast: DataFrame) -> DataFrame:
    """ROAS by quantile, three rows per (scenario, channel)."""
    return forecast.select("scenario_id", "channel", "roas_low", "roas_median", "roas_high").unpivot(
        ["scenario_id", "channel"], ["roas_low", "roas_median", "roas_high"], "quantile", "roas")


def budget_share(scenarios: DataFrame) -> DataFrame:
    """Planned spend as a share of the scenario's total (4 dp)."""
    totals = scenarios.groupBy("scenario_id").agg(F.sum(exact("planned_spend")).cast("double").alias("total"))
    total = F.col("total")
    return scenarios.join(totals, "scenario_id").select("scenario_id", "channel", "planned_spend",
                            F.when(total != 0, out_round(F.col("planned_spend") / total, 4))
                            .otherwise(F.lit(0.0)).alias("share"))
