"""Weekly features: calendar fields, lags, rolling means, future grid.

Windows are partitioned by the series keys and ordered by week. They run on
weekly rows (one per series and week), so a partition is bounded by the
calendar length whatever the daily volume of a hot channel or campaign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact

PROMO_WEEKS = (47, 50)  # fixed values: ISO weeks flagged as promotion period, inclusive


def week_of_year(c="week") -> Column:
    return F.weekofyear(c).cast("int")


def promo_flags(weekly_df: DataFrame) -> DataFrame:
    """``is_promo`` = ISO week 47–50; reuses an existing ``week_of_year`` column."""
    df = weekly_df if "week_of_year" in weekly_df.columns else weekly_df.withColumn("week_of_year", week_of_year())
    lo, hi = PROMO_WEEKS
    return df.withColumn("is_promo", F.col("week_of_year").between(lo, hi).cast("int"))


def _exact_mean(c: str, w) -> Column:
    return F.sum(exact(c)).over(w).cast("double") / F.count(c).over(w).cast("double")


def build_features(weekly_df: DataFrame, keys: list[str]) -> DataFrame:
    """month, quarter, ISO week, lag 1 / lag 4 (missing → series mean), rolling mean of last 4 rows.

    Lags are by row position within the series (a missing week is not filled).
    """
    ordered = Window.partitionBy(*keys).orderBy("week")
    whole = Window.partitionBy(*keys)
    rolling = ordered.rowsBetween(-3, 0)
    mean = _exact_mean("spend", whole)
    return weekly_df.select(
        "*",
        F.month("week").cast("int").alias("month"),
        F.quarter("week").cast("int").alias("quarter"),
        week_of_year().alias("week_of_year"),
        F.coalesce(F.lag("spend", 1).over(ordered), mean).alias("spend_lag1"),
        F.coalesce(F.lag("spend", 4).over(ordered), mean).alias("spend_lag4"),
        _exact_mean("spend", rolling).alias("spend_rolling4"),
    )


def horizon_columns(h: Column) -> dict[str, Column]:
    """n future weeks = max(ceil(h/7), 1); equivalent weeks h/7; scale = (h/7)/n."""
    eq = h.cast("double") / F.lit(7.0)
    n = F.greatest(F.ceil(eq), F.lit(1)).cast("int")
    return {"n_future": n, "equivalent_weeks": eq, "horizon_scale": eq / n.cast("double")}


def weekly_spend(planned: Column, eq: Column) -> Column:
    """Exact-period spend as a full-week rate (0 when the horizon is empty)."""
    return F.when(eq != 0, planned.cast("double") / eq).otherwise(F.lit(0.0))


def series_tail(weekly_df: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: weeks, last week, last spend, exact sums of the last 1..4 spends."""
    w = Window.partitionBy(*keys).orderBy(F.col("week").desc())
    ranked = weekly_df.select(*keys, "week", "spend", F.row_number().over(w).alias("rn"))
    aggs = [
        F.count(F.lit(1)).alias("n_hist"),
        F.max("week").alias("last_week"),
        F.max(F.when(F.col("rn") == 1, F.col("spend"))).alias("last_spend"),
    ]
    for j in range(1, 5):
        aggs.append(F.coalesce(F.sum(F.when(F.col("rn") <= j, exact("spend"))).cast("double"), F.lit(0.0))
                    .alias(f"tail{j}"))
    return ranked.groupBy(*keys).agg(*aggs)


def future_week_grid(weekly_df: DataFrame, keys: list[str], horizons: DataFrame) -> DataFrame:
    """Mondays after each series' last week for every requested horizon."""
    last = weekly_df.groupBy(*keys).agg(F.max("week").alias("last_week"))
    hz = horizons.select(F.col("horizon_days").cast("int").alias("horizon_days")).distinct()
    grid = last.crossJoin(F.broadcast(hz)).withColumns(horizon_columns(F.col("horizon_days")))
    return grid.select(
        *keys, "horizon_days", F.explode(F.sequence(F.lit(1), F.col("n_future"))).alias("step"),
        "last_week", "n_future", "equivalent_weeks", "horizon_scale",
    ).withColumn("week", F.date_add("last_week", F.col("step") * 7)).drop("last_week")


def future_features(weekly_df: DataFrame, keys: list[str], scenarios: DataFrame) -> DataFrame:
    """Scoring rows for every (scenario, series, future week).

    Future spend is the constant weekly rate, so the recursive look-back has a
    closed form: at step k the last 4 values of history ++ (k-1) future weeks
    hold ``w = min(k-1, 4)`` future weeks and ``h = min(n_hist, 4-w)`` history
    weeks; lag 4 and rolling 4 are both their mean, lag 1 the previous value.
    """
    tail = series_tail(weekly_df, keys)
    sc = scenarios.withColumns(horizon_columns(F.col("horizon_days")))
    sc = sc.withColumn("weekly_spend", weekly_spend(F.col("planned_spend"), F.col("equivalent_weeks")))
    rows = sc.join(tail, keys, "inner").select(
        "scenario_id", *keys, "planned_spend", "horizon_days", "n_future", "equivalent_weeks", "horizon_scale",
        "weekly_spend", "n_hist", "last_week", "last_spend", "tail1", "tail2", "tail3", "tail4",
        F.explode(F.sequence(F.lit(1), F.col("n_future"))).alias("step"))
    w_fut = F.least(F.col("step") - 1, F.lit(4))
    h_hist = F.least(F.col("n_hist"), F.lit(4) - w_fut)
    tail_sum = (F.when(h_hist == 1, F.col("tail1")).when(h_hist == 2, F.col("tail2"))
                .when(h_hist == 3, F.col("tail3")).when(h_hist == 4, F.col("tail4")).otherwise(F.lit(0.0)))
    cnt = w_fut + h_hist
    mean4 = F.when(cnt > 0, (tail_sum + w_fut * F.col("weekly_spend")) / cnt.cast("double")) \
        .otherwise(F.col("weekly_spend"))
    lag1 = F.when((F.col("step") == 1) & (F.col("n_hist") > 0), F.col("last_spend")).otherwise(F.col("weekly_spend"))
    week = F.date_add("last_week", F.col("step") * 7)
    return rows.select(
        "scenario_id", *keys, "horizon_days", "step", week.alias("week"),
        F.col("weekly_spend").alias("spend"),
        F.month(week).cast("int").alias("month"),
        F.quarter(week).cast("int").alias("quarter"),
        F.weekofyear(week).cast("int").alias("week_of_year"),
        lag1.alias("spend_lag1"), mean4.alias("spend_lag4"), mean4.alias("spend_rolling4"),
        "horizon_scale",
    )
