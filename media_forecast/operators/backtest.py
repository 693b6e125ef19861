"""Sliding-window back-test, all series and windows in one job.

Window ``i`` (0-based) of a series ends ``i × horizon`` days before the
series' last date and spans ``horizon`` days inclusive; its training set is
every earlier day. For each (series, window) the models are refitted on the
weekly training rows, scored at the window's actual spend and combined
without caps, then compared with the actual revenue.

Plan shape: daily rows are first reduced to one row per (series, date), so a
hot campaign is pre-combined before the shuffle. Then each series is read once
in the order of time, with running totals (:func:`running_totals`). The days
before and at the end of each window are marks in that order, so the totals
"as of" a mark are simply its own: a window's actuals are the difference of two
marks, and the regression moments of its training weeks are those of one mark.
Nothing is joined with the windows and no row is repeated for them; the fits
cost the same for any number of windows.

Only the ratio bands need the single weeks again, because every window has its
own fitted line: they come from one array of weeks per series (bounded by the
calendar), in place, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import exact, exact_sum, out_round
from . import models, scenarios
from .kpis import dated

DEFAULT_HORIZON = 30
DEFAULT_WINDOWS = 3


def series_daily(df: DataFrame, keys: list[str], undated: Observation | None = None) -> DataFrame:
    return (dated(df, keys, undated)
            .groupBy(*keys, "date").agg(exact_sum("spend").alias("spend"), exact_sum("revenue").alias("revenue")))


def windows(daily: DataFrame, keys: list[str], horizon: int = DEFAULT_HORIZON, n_windows: int = DEFAULT_WINDOWS) -> DataFrame:
    last = daily.groupBy(*keys).agg(F.max("date").alias("max_date"))
    w = last.select(*keys, "max_date", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("window_index"))
    end = F.date_sub("max_date", F.col("window_index") * horizon)
    return w.select(*keys, "window_index", F.date_sub(end, horizon - 1).alias("window_start"), end.alias("window_end"))


def running_totals(daily: DataFrame, keys: list[str], marks: str) -> DataFrame:
    """Days and marks of each series in order, each with the totals up to and including its day.

    ``marks`` is an expression for an array of ``struct<day, mark>``, evaluated
    on a series' last row (it may use ``max_date``). Totals: ``rows`` (days with
    data), ``n_weeks``, ``sx``, ``sy``, and the moments ``sxx``, ``sxy``, ``syy`` of *weekly*
    sums; the week that the day falls in counts with its days so far (``wx``,
    ``wy``, ``wn``). A day adds to a week's square what the week's new sum adds to
    it, so a partial last week needs no second look at its days.
    """
    k = ", ".join(f"`{c}`" for c in keys)
    rows = daily.select(*keys, F.col("date").alias("day"), exact("spend").cast(models.AMOUNT).alias("x"),
                        exact("revenue").cast(models.AMOUNT).alias("y"), F.max("date").over(Window.partitionBy(*keys)).alias("max_date"))
    own = "array(struct(day, CAST(NULL AS int) AS mark, x, y))"
    zero = f"CAST(0 AS {models.AMOUNT})"
    marked = f"transform({marks}, m -> struct(m.day AS day, CAST(m.mark AS int) AS mark, {zero} AS x, {zero} AS y))"
    rows = rows.selectExpr(*keys, f"inline(IF(day = max_date, concat({own}, {marked}), {own}))")
    # Both windows sort by (keys, week, day, mark): one shuffle on the series, one sort. Days come before marks of the day.
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    in_week = f"(PARTITION BY {k}, week ORDER BY day, mark NULLS FIRST {so_far})"
    rows = rows.selectExpr("*", "CAST(date_trunc('week', day) AS date) AS week").selectExpr(
        "*", f"CAST(sum(x) OVER {in_week} AS {models.AMOUNT}) AS wx", f"CAST(sum(y) OVER {in_week} AS {models.AMOUNT}) AS wy",
        f"count_if(mark IS NULL) OVER {in_week} AS wn")
    before_x, before_y = f"CAST(wx - x AS {models.AMOUNT})", f"CAST(wy - y AS {models.AMOUNT})"
    adds = {
        "rows": "IF(mark IS NULL, 1, 0)", "n_weeks": "IF(mark IS NULL AND wn = 1, 1, 0)", "sx": "x", "sy": "y",
        "sxx": f"wx * wx - {before_x} * {before_x}", "sxy": f"wx * wy - {before_x} * {before_y}", "syy": f"wy * wy - {before_y} * {before_y}",
    }
    in_series = f"PARTITION BY {k} ORDER BY week, day, mark NULLS FIRST"
    return rows.selectExpr(
        *keys, "day", "mark", "week", "wx", "wy", "wn", *[f"sum({add}) OVER ({in_series} {so_far}) AS {name}" for name, add in adds.items()],
        f"wn > 0 AND coalesce(lead(week) OVER ({in_series}) <> week, true) AS week_done")


def window_totals(daily: DataFrame, keys: list[str], horizon: int = DEFAULT_HORIZON, n_windows: int = DEFAULT_WINDOWS) -> DataFrame:
    """One row per (series, window): actuals, moments of the training weeks, and the training weeks as an array.

    Columns: keys, window_index, window_start, window_end, ``rows`` (days with
    data in the window), actual, actual_spend, n_weeks, sx, sy, sxx, sxy, syy,
    and ``train`` (array of week, x, y).
    """
    # Mark 2i is the last day of window i, mark 2i + 1 the day before its first.
    marks = (f"flatten(transform(sequence(0, {n_windows - 1}), i -> array(struct(date_sub(max_date, i * {horizon}) AS day, 2 * i AS mark), "
             f"struct(date_sub(max_date, (i + 1) * {horizon}) AS day, 2 * i + 1 AS mark))))")
    run = running_totals(daily, keys, marks)
    at = "mark, day, week, wx, wy, wn, rows, n_weeks, sx, sy, sxx, sxy, syy"
    series = run.groupBy(*keys).agg(
        F.expr(f"array_sort(collect_list(IF(mark IS NOT NULL, struct({at}), NULL)))").alias("marks"),
        F.expr("collect_list(IF(week_done, struct(week, wx AS x, wy AS y), NULL))").alias("weeks"),
    )
    one = series.selectExpr(*keys, "weeks", "marks", f"explode(sequence(0, {n_windows - 1})) AS window_index").selectExpr(
        *keys, "window_index", "weeks", "get(marks, 2 * window_index) AS end", "get(marks, 2 * window_index + 1) AS open")
    full = "filter(weeks, w -> w.week < open.week)"
    return one.selectExpr(
        *keys, "window_index", "date_add(open.day, 1) AS window_start", "end.day AS window_end", "end.rows - open.rows AS rows",
        "CAST(end.sy - open.sy AS double) AS actual", "CAST(end.sx - open.sx AS double) AS actual_spend",
        "open.n_weeks AS n_weeks", *[f"open.{c} AS {c}" for c in ("sx", "sy", "sxx", "sxy", "syy")],
        f"IF(open.wn > 0, concat({full}, array(struct(open.week AS week, open.wx AS x, open.wy AS y))), {full}) AS train")


def actuals(daily: DataFrame, keys: list[str], horizon: int = DEFAULT_HORIZON, n_windows: int = DEFAULT_WINDOWS) -> DataFrame:
    """Actual revenue and spend inside each window (windows with no rows drop out)."""
    return (window_totals(daily, keys, horizon, n_windows).filter(F.col("rows") > 0)
            .select(*keys, "window_index", "window_end", "actual", "actual_spend"))


def train_weekly(daily: DataFrame, keys: list[str], horizon: int = DEFAULT_HORIZON, n_windows: int = DEFAULT_WINDOWS) -> DataFrame:
    """Weekly training series per window: everything strictly before the window start."""
    rows = window_totals(daily, keys, horizon, n_windows).select(*keys, "window_index", F.explode("train").alias("t"))
    return rows.select(*keys, "window_index", "t.week", F.col("t.x").cast("double").alias("spend"),
                       F.col("t.y").cast("double").alias("revenue"))


def fits(totals: DataFrame) -> DataFrame:
    """Rows of :func:`window_totals` with the model that their training weeks give."""
    t = totals.filter(F.col("n_weeks") > 0).withColumns({
        "min_x": F.expr("array_min(train.x)"), "min_y": F.expr("array_min(train.y)"),
        **{c: F.col(c).cast("double") for c in ("sx", "sy", "sxx", "sxy", "syy")}})
    t = models.with_line(t, models.centred_moments("train"))
    ratios = F.transform("train", lambda w: models.ratio(w["x"].cast("double"), w["y"].cast("double")))
    return models.banded(t.withColumn("ratios", F.sort_array(F.array_compact(ratios))))


def runs(df: DataFrame, keys: list[str] | None = None, horizon: int = DEFAULT_HORIZON,
         n_windows: int = DEFAULT_WINDOWS, daily: DataFrame | None = None) -> DataFrame:
    """(series, window_end, actual, p10, p50, p90) for every window with train and test rows."""
    keys = keys or ["channel"]
    daily = daily if daily is not None else series_daily(df, keys)
    fitted = fits(window_totals(daily, keys, horizon, n_windows).filter(F.col("rows") > 0))
    kept = [*keys, "window_end", "actual", "actual_spend", "intercept", "slope", "sigma", "r10", "r50", "r90"]
    scored = models.score_fitted(fitted.select(*kept, F.lit(horizon).alias("horizon_days")), spend_col="actual_spend")
    comb = scenarios.combine_bands(*[F.col(c) for c in ("p_low", "p_median", "p_high", "q_low", "q_median", "q_high")])
    return scored.select(*keys, "window_end", "actual", comb["revenue_low"].alias("p10"),
                         comb["revenue_median"].alias("p50"), comb["revenue_high"].alias("p90"))


def score(run_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean absolute % error (windows with actual > 0; 0.0 if none), interval coverage, window count.

    Errors are summed in ascending order over the (few) windows of a series,
    so the mean does not depend on task order.
    """
    keys = keys or ["channel"]
    err = F.when(F.col("actual") > 0, F.abs(F.col("actual") - F.col("p50")) / F.col("actual"))
    g = run_rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(err)).alias("errs"),
        F.count_if((F.col("p10") <= F.col("actual")) & (F.col("actual") <= F.col("p90"))).alias("covered"),
        F.count(F.lit(1)).alias("windows_tested"),
    )
    total = F.aggregate("errs", F.lit(0.0), lambda acc, x: acc + x)
    aape = F.when(F.size("errs") > 0, total / F.size("errs").cast("double")).otherwise(F.lit(0.0))
    return g.select(*keys, out_round(aape, 4).alias("aape"),
                    out_round(F.col("covered") / F.col("windows_tested").cast("double"), 4).alias("coverage_prob"),
                    "windows_tested")
