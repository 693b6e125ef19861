"""Learned series models: batches of series give what each series gives alone."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from media_forecast.operators import features, series_models

KEYS = ["channel", "campaign_id"]
WEEKS = {"a": 1, "b": 5, "c": 40, "d": 40, "e": 130, "f": 40}  # series f has the same spend in all weeks


def weekly(spark):
    rows, rng = [], np.random.default_rng(7)
    for name, n in WEEKS.items():
        for i in range(n):
            spend = 10.0 if name == "f" else float(rng.uniform(1, 100))
            rows.append(("Google" if name < "d" else None, name, dt.date(1994, 1, 3) + dt.timedelta(7 * i), spend,
                         3 * spend + float(rng.uniform(0, 50))))
    rng.shuffle(rows)
    return spark.createDataFrame([(*r[:2], r[2], float(r[3]), float(r[4])) for r in rows],
                                 "channel string, campaign_id string, week date, spend double, revenue double")


def alone(rows, tau):
    """Pinball coefficients of one series by itself."""
    rows = sorted(rows, key=lambda r: r.week)
    Xr = np.array([[float(r[c]) for c in series_models.QUANTILE_FEATURES] for r in rows])
    y = np.array([r.revenue for r in rows])
    sd = Xr.std(axis=0)
    sd[sd == 0] = 1.0
    X = np.hstack([np.ones((len(y), 1)), (Xr - Xr.mean(axis=0)) / sd])
    ridge = 1e-6 * np.eye(X.shape[1])
    ridge[0, 0] = 0.0
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    for _ in range(series_models.QUANTILE_ROUNDS):
        r = y - X @ beta
        w = np.where(r >= 0, tau, 1.0 - tau) / np.maximum(np.abs(r), 1e-6 * (np.abs(y).mean() + 1.0))
        beta = np.linalg.solve(X.T @ (X * w[:, None]) + ridge + 1e-12 * np.eye(X.shape[1]), X.T @ (w * y))
    return X @ beta


@pytest.mark.parametrize("fit", [series_models.fit_trend, series_models.fit_quantile])
def test_a_python_call_takes_a_batch_of_series(spark, fit):
    fitted = fit(weekly(spark), KEYS)
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {r.campaign_id: r for r in fitted.collect()}
    assert {k: r.n_weeks for k, r in got.items()} == WEEKS
    assert {k: r.channel for k, r in got.items()} == {k: "Google" if k < "d" else None for k in WEEKS}


def test_quantile_batches_equal_single_series(spark):
    df = weekly(spark)
    fitted = {r.campaign_id: r for r in series_models.fit_quantile(df, KEYS).collect()}
    rows = features.build_features(df, KEYS).collect()
    for name in WEEKS:
        own = sorted((r for r in rows if r.campaign_id == name), key=lambda r: r.week)
        f = fitted[name]
        z = (np.array([[float(r[c]) for c in series_models.QUANTILE_FEATURES] for r in own]) - f.feature_mean) / f.feature_std
        for level, tau in series_models.LEVELS.items():
            predicted = np.hstack([np.ones((len(own), 1)), z]) @ np.array(f[level])
            assert np.allclose(predicted, alone(own, tau), rtol=1e-6, atol=1e-4), (name, level)


def test_trend_batches_equal_each_series_alone(spark):
    df = weekly(spark)
    together = sorted(series_models.fit_trend(df, KEYS).collect(), key=lambda r: r.campaign_id)
    apart = [series_models.fit_trend(df.where(f"campaign_id = '{k}'"), KEYS).first() for k in sorted(WEEKS)]
    assert together == apart
    assert [len(r.params) for r in together] == [3, 3, 3 + 5, 3 + 5, 3 + 10 + 6, 3 + 5]
    assert series_models.fit_trend(df.limit(0), KEYS).collect() == []
    assert series_models.fit_quantile(df.limit(0), KEYS).collect() == []
