"""The back-test from running totals equals refitting every window on its own rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from media_forecast.functions import exact_sum, week_start
from media_forecast.operators import backtest, models, scenarios

KEYS = ["channel"]


def naive_parts(daily, horizon, n):
    """Windows joined with every day, as the definition has it."""
    win = backtest.windows(daily, KEYS, horizon, n)
    rows = daily.join(win, KEYS)
    act = rows.where("date BETWEEN window_start AND window_end").groupBy(*KEYS, "window_index", "window_end").agg(
        exact_sum("revenue").alias("actual"), exact_sum("spend").alias("actual_spend"))
    train = rows.where("date < window_start").groupBy(*KEYS, "window_index", week_start("date").alias("week")).agg(
        exact_sum("spend").alias("spend"), exact_sum("revenue").alias("revenue"))
    return act, train


def naive_runs(daily, horizon, n):
    act, train = naive_parts(daily, horizon, n)
    keys = [*KEYS, "window_index"]
    scored = models.score_horizon(models.fit_spend_response(train, keys), keys, act.withColumn("horizon_days", F.lit(horizon)),
                                  spend_col="actual_spend").where("intercept IS NOT NULL")
    c = scenarios.combine_bands(*[F.col(x) for x in ("p_low", "p_median", "p_high", "q_low", "q_median", "q_high")])
    return scored.select(*KEYS, "window_end", "actual", c["revenue_low"].alias("p10"), c["revenue_median"].alias("p50"),
                         c["revenue_high"].alias("p90"))


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def daily(spark):
    r = random.Random(6)
    rows = []
    for name, days, share, spend in (
        ("dense", 200, 1.0, lambda: round(r.uniform(0, 900), 6)), ("sparse", 300, 0.2, lambda: round(r.uniform(0, 9), 2)),
        ("flat", 150, 1.0, lambda: 70.0), ("nearly flat", 154, 1.0, lambda: 1e6 + r.choice((0.0, 0.000001))), ("one day", 1, 1.0, lambda: 5.0),
        ("short", 12, 1.0, lambda: 3.5), ("negative", 90, 0.7, lambda: r.choice((0.0, -2.0, 4.25))),
    ):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=r.randint(0, 20))
        for k in range(days):
            if k == 0 or r.random() < share:
                x = spend()
                rows.append((name, start + dt.timedelta(days=k), x, round(2 * x + r.uniform(0, 50), 6)))
    return spark.createDataFrame(rows, "channel string, date date, spend double, revenue double").repartition(5)


@pytest.mark.parametrize("horizon,n", [(30, 1), (30, 3), (7, 6), (1, 4), (10, 5)])
def test_equals_refitting(daily, horizon, n):
    act, train = naive_parts(daily, horizon, n)
    assert rows_of(backtest.actuals(daily, KEYS, horizon, n)) == rows_of(act)
    assert rows_of(backtest.train_weekly(daily, KEYS, horizon, n)) == rows_of(train)
    got, want = rows_of(backtest.runs(None, KEYS, horizon, n, daily)), rows_of(naive_runs(daily, horizon, n))
    assert got == want
    assert len(got) > n


def test_more_windows_add_no_join_or_shuffle(daily):
    plans = []
    for n in (1, 6):
        df = backtest.runs(None, KEYS, 30, n, daily)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "Join" not in plan and "Cartesian" not in plan
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_empty_input(spark, daily):
    none = daily.limit(0)
    assert backtest.runs(None, KEYS, 30, 3, none).count() == backtest.actuals(none, KEYS).count() == 0
