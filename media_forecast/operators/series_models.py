"""Learned per-series models (level ii): fitted with ``mapInArrow``, scored in SQL.

* Trend model (the time-series role): ridge regression of weekly revenue on a
  piecewise-linear trend (hinge changepoints over the first 95 % of history),
  yearly Fourier terms when at least two years are present, and standardised
  spend as a regressor; interval = ±z·residual σ for a 75 % band.
* Quantile model (the quantile role): linear pinball regression for P10, P50
  and P90 on the seven weekly features, by iteratively reweighted least
  squares with a fixed number of rounds.

A series' weekly rows become one row of arrays in the order of weeks (bounded
by the calendar), so results do not depend on row arrival order. A Python call
fits a batch of series; the quantile model solves those with equally many weeks
together. Fitted parameters come back as arrays and scoring joins them to
future rows and takes dot products with higher-order array functions, all
JVM-side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import out_round
from . import features as feat
from .models import QUANTILES, Z_INTERVAL
from ..shipping import ship_package

CHANGEPOINT_RANGE = 0.95  # fixed value: changepoints placed over the first 95 % of history
MAX_CHANGEPOINTS = 10
YEARLY_ORDER = 3
MIN_SPAN_FOR_YEARLY = 730  # days: yearly terms only with two years of history
TREND_RIDGE = 1.0
QUANTILE_ROUNDS = 60
QUANTILE_FEATURES = ["spend", "month", "quarter", "week_of_year", "spend_lag1", "spend_lag4", "spend_rolling4"]
LEVELS = {f"q{int(round(q * 100))}": q for q in QUANTILES}
SERIES_AT_ONCE = 64  # series solved together: memory bound only
DAYS_PER_YEAR = 365.25


def _fourier(days_since_epoch: np.ndarray, order: int) -> np.ndarray:
    if order == 0:
        return np.zeros((len(days_since_epoch), 0))
    ang = 2.0 * math.pi * days_since_epoch[:, None] / DAYS_PER_YEAR * np.arange(1, order + 1)[None, :]
    return np.concatenate([np.sin(ang), np.cos(ang)], axis=1)


def _trend_design(t, cps, epoch_days, order, spend_z):
    hinge = np.maximum(t[:, None] - np.asarray(cps)[None, :], 0.0) if len(cps) else np.zeros((len(t), 0))
    return np.concatenate([np.ones((len(t), 1)), t[:, None], hinge, _fourier(epoch_days, order), spend_z[:, None]],
                          axis=1)


def _fit_trend_series(week: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict:
    """Parameters of one series: its weeks in order (days since the epoch), spend and revenue."""
    days = (week - week[0]).astype(float)
    span = max(float(days[-1]), 1.0)
    t = days / span
    n = len(week)
    mu, sd = float(x.mean()), float(x.std())
    sd = sd if sd > 0 else 1.0
    k = min(MAX_CHANGEPOINTS, n // 8)
    head = t[: max(1, int(math.ceil(CHANGEPOINT_RANGE * n)))]
    cps = np.quantile(head, np.linspace(0, 1, k + 2)[1:-1]) if k > 0 else np.zeros(0)
    order = YEARLY_ORDER if float(days[-1]) >= MIN_SPAN_FOR_YEARLY else 0
    X = _trend_design(t, cps, week.astype(float), order, (x - mu) / sd)
    pen = np.full(X.shape[1], TREND_RIDGE)
    pen[0] = 0.0
    beta = np.linalg.solve(X.T @ X + np.diag(pen) + 1e-9 * np.eye(X.shape[1]), X.T @ y)
    resid = y - X @ beta
    sigma = float(np.sqrt((resid ** 2).sum() / max(n - 2, 1))) if n > 2 else 0.0
    return dict(n_weeks=n, first_week=int(week[0]), last_week=int(week[-1]), span_days=span, changepoints=cps, fourier_order=order,
                spend_mean=mu, spend_std=sd, params=beta, sigma=sigma)


def series_arrays(weekly_df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per series: its keys and, in the order of weeks, an array of ``week`` (days since the epoch) and of each column.

    A series is bounded by the calendar, so the arrays are too.
    """
    day = F.unix_date(F.col("week").cast("date")).alias("week")
    rows = F.sort_array(F.collect_list(F.struct(day, *[F.col(c).cast("double").alias(c) for c in columns])))
    one = weekly_df.groupBy(*keys).agg(rows.alias("__rows"))
    return one.select(*keys, *[F.col(f"__rows.{c}").alias(f"__{c}") for c in ("week", *columns)])


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each series of an array column begins (and the last one ends), and the values of all; missing ones are NaN."""
    arrays = batch.column(f"__{column}")
    return arrays.offsets.to_numpy(), arrays.values.to_numpy(zero_copy_only=False)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *arrays])))


def _fitted(batch: pa.RecordBatch, keys: list[str], found: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *found.values()], names=[*keys, *found])


def _fit_trend_batches(keys: list[str]):
    def fit(batches):
        for b in batches:
            (at, week), (_, x), (_, y) = _flat(b, "week"), _flat(b, "spend"), _flat(b, "revenue")
            rows = [_fit_trend_series(week[i:j], x[i:j], y[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            kinds = dict(n_weeks=pa.int64(), first_week=pa.date32(), last_week=pa.date32(), span_days=pa.float64(), changepoints=None,
                         fourier_order=pa.int32(), spend_mean=pa.float64(), spend_std=pa.float64(), params=None, sigma=pa.float64())
            yield _fitted(b, keys, {c: pa.array([r[c] for r in rows], kind) if kind else _lists([r[c] for r in rows])
                                    for c, kind in kinds.items()})
    return fit


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def fit_trend(weekly_df: DataFrame, keys: list[str]) -> DataFrame:
    ship_package(weekly_df.sparkSession)
    schema = T.StructType(_key_fields(weekly_df, keys) + [
        T.StructField("n_weeks", T.LongType()),
        T.StructField("first_week", T.DateType()),
        T.StructField("last_week", T.DateType()),
        T.StructField("span_days", T.DoubleType()),
        T.StructField("changepoints", T.ArrayType(T.DoubleType())),
        T.StructField("fourier_order", T.IntegerType()),
        T.StructField("spend_mean", T.DoubleType()),
        T.StructField("spend_std", T.DoubleType()),
        T.StructField("params", T.ArrayType(T.DoubleType())),
        T.StructField("sigma", T.DoubleType()),
    ])
    return series_arrays(weekly_df.repartition(*keys), keys, ["spend", "revenue"]).mapInArrow(_fit_trend_batches(keys), schema)


def _dot(features: Column, params: Column) -> Column:
    return F.aggregate(F.zip_with(features, params, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def trend_design(week: Column, spend: Column) -> Column:
    """Design row for ``week`` / ``spend`` against fitted trend columns (SQL side of ``_trend_design``)."""
    t = F.datediff(week, F.col("first_week")).cast("double") / F.col("span_days")
    hinge = F.transform("changepoints", lambda c: F.greatest(t - c, F.lit(0.0)))
    ed = F.datediff(week, F.lit("1970-01-01").cast("date")).cast("double")
    ks = F.sequence(F.lit(1), F.greatest(F.col("fourier_order"), F.lit(1)))
    ang = F.transform(ks, lambda k: F.lit(2.0 * math.pi) * ed / F.lit(DAYS_PER_YEAR) * k.cast("double"))
    sin = F.when(F.col("fourier_order") > 0, F.transform(ang, F.sin)).otherwise(F.array().cast("array<double>"))
    cos = F.when(F.col("fourier_order") > 0, F.transform(ang, F.cos)).otherwise(F.array().cast("array<double>"))
    z = (spend - F.col("spend_mean")) / F.col("spend_std")
    return F.concat(F.array(F.lit(1.0), t), hinge, sin, cos, F.array(z))


def trend_forecast(fit: DataFrame, keys: list[str], requests: DataFrame, spend_col: str = "planned_spend") -> DataFrame:
    """Per request: future Mondays after the series' last week at the weekly spend rate;
    yhat and its ±z·σ band clipped at 0, summed, scaled to the exact window (2 dp)."""
    r = requests.withColumns(feat.horizon_columns(F.col("horizon_days")))
    r = r.withColumn("weekly_spend", feat.weekly_spend(F.col(spend_col), F.col("equivalent_weeks")))
    grid = (r.join(fit, keys, "inner")
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n_future")))))
    week = F.date_add("last_week", F.col("step") * 7)
    yhat = _dot(trend_design(week, F.col("weekly_spend")), F.col("params"))
    band = F.lit(Z_INTERVAL) * F.col("sigma")
    req_cols = [c for c in requests.columns]
    per_week = grid.select(*req_cols, "horizon_scale",
                           F.greatest(yhat - band, F.lit(0.0)).alias("lo"),
                           F.greatest(yhat, F.lit(0.0)).alias("mid"),
                           F.greatest(yhat + band, F.lit(0.0)).alias("hi"))
    g = per_week.groupBy(*req_cols).agg(F.sum("lo").alias("lo"), F.sum("mid").alias("mid"), F.sum("hi").alias("hi"),
                                        F.max("horizon_scale").alias("horizon_scale"))
    return g.select(*req_cols, *[out_round(F.col(c) * F.col("horizon_scale")).alias(f"p_{n}")
                                 for c, n in (("lo", "low"), ("mid", "median"), ("hi", "high"))])


def _pinball_irls(XT: np.ndarray, y: np.ndarray, start: np.ndarray, tau: float) -> np.ndarray:
    """Coefficients of several series with equally many weeks: designs (series, feature, week), revenue (series, week), first guesses."""
    p = XT.shape[1]
    ridge = 1e-6 * np.eye(p)
    ridge[0, 0] = 0.0
    X = XT.transpose(0, 2, 1)
    beta = start[:, :, None]
    eps = 1e-6 * (np.abs(y).mean(axis=1, keepdims=True) + 1.0)
    for _ in range(QUANTILE_ROUNDS):
        r = y - (X @ beta)[:, :, 0]
        w = np.where(r >= 0, tau, 1.0 - tau) / np.maximum(np.abs(r), eps)
        A = XT @ (XT * w[:, None, :]).transpose(0, 2, 1) + ridge
        beta = np.linalg.solve(A + 1e-12 * np.eye(p), XT @ (w * y)[:, :, None])
    return beta[:, :, 0]


def _fit_quantile_batches(keys: list[str]):
    def fit(batches):
        for b in batches:
            at, y = _flat(b, "revenue")
            values = [_flat(b, c)[1] for c in QUANTILE_FEATURES]
            weeks = np.diff(at)
            found = {c: np.zeros((len(weeks), len(QUANTILE_FEATURES) + (c[0] == "q"))) for c in ("feature_mean", "feature_std", *LEVELS)}
            # Series with equally many weeks are solved together, as many as stay in the processor's cache.
            for n in np.unique(weeks):
                same = np.flatnonzero(weeks == n)
                for some in np.split(same, range(SERIES_AT_ONCE, len(same), SERIES_AT_ONCE)):
                    rows = at[some][:, None] + np.arange(n)
                    Xr = np.stack([v[rows] for v in values], axis=1)
                    mu, sd = Xr.mean(axis=2), Xr.std(axis=2)
                    sd[sd == 0] = 1.0
                    XT = np.concatenate([np.ones((len(some), 1, n)), (Xr - mu[:, :, None]) / sd[:, :, None]], axis=1)
                    start = np.stack([np.linalg.lstsq(X.T, revenue, rcond=None)[0] for X, revenue in zip(XT, y[rows], strict=True)])
                    found["feature_mean"][some], found["feature_std"][some] = mu, sd
                    for c, q in LEVELS.items():
                        found[c][some] = _pinball_irls(XT, y[rows], start, q)
            yield _fitted(b, keys, {"n_weeks": pa.array(weeks, pa.int64()), **{c: _lists([*v]) for c, v in found.items()}})
    return fit


def fit_quantile(weekly_df: DataFrame, keys: list[str]) -> DataFrame:
    ship_package(weekly_df.sparkSession)
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType(_key_fields(weekly_df, keys) + [
        T.StructField("n_weeks", T.LongType()),
        T.StructField("feature_mean", arr), T.StructField("feature_std", arr),
        *[T.StructField(c, arr) for c in LEVELS],
    ])
    rows = feat.build_features(weekly_df, keys)
    return series_arrays(rows, keys, ["revenue", *QUANTILE_FEATURES]).mapInArrow(_fit_quantile_batches(keys), schema)


def quantile_forecast(fit: DataFrame, keys: list[str], future_rows: DataFrame) -> DataFrame:
    """Score future feature rows (from ``features.future_features``), order the three
    predictions per week, sum per (scenario, series) and scale (2 dp)."""
    j = future_rows.join(fit, keys, "inner")
    x = F.array(*[F.col(c).cast("double") for c in QUANTILE_FEATURES])
    z = F.zip_with(F.zip_with(x, F.col("feature_mean"), lambda a, m: a - m), F.col("feature_std"),
                   lambda a, s: a / s)
    design = F.concat(F.array(F.lit(1.0)), z)
    preds = [F.greatest(_dot(design, F.col(c)), F.lit(0.0)) for c in LEVELS]
    srt = F.array_sort(F.array(*preds))
    per_week = j.select("scenario_id", *keys, "horizon_days", "horizon_scale",
                        F.element_at(srt, 1).alias("lo"), F.element_at(srt, 2).alias("mid"),
                        F.element_at(srt, 3).alias("hi"))
    g = per_week.groupBy("scenario_id", *keys, "horizon_days").agg(
        F.sum("lo").alias("lo"), F.sum("mid").alias("mid"), F.sum("hi").alias("hi"),
        F.max("horizon_scale").alias("horizon_scale"))
    return g.select("scenario_id", *keys, "horizon_days",
                    *[out_round(F.col(c) * F.col("horizon_scale")).alias(f"q_{n}")
                      for c, n in (("lo", "low"), ("mid", "median"), ("hi", "high"))])
