"""Many-series revenue models, closed form (level i).

For every series (any key set) on its weekly rows:

* spend response: least-squares ``revenue = a + b * spend`` from exact moment
  sums, with the residual spread ``sigma``; a series whose spend is the same
  in every week falls back to its mean revenue (slope 0). Where plain moments
  would cancel, moments from the smallest spend and revenue are used;
* ratio bands: P10 / P50 / P90 of ``revenue / fitted`` over weeks with a
  positive fit (linear interpolation between order statistics).

All of it is one shuffle on the series keys and one aggregate: exact moment
sums and the array of a series' weeks, in which the ratios are ordered in
place. Each series is bounded by its number of weeks.

Horizon scoring of these models is pure column arithmetic (no Python), so a
scenario table of any size joins the coefficients and is scored in place.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import out_round
from .features import horizon_columns, weekly_spend

INTERVAL_WIDTH = 0.75  # fixed value: width of the trend-model interval
Z_INTERVAL = NormalDist().inv_cdf(0.5 + INTERVAL_WIDTH / 2)
QUANTILES = (0.10, 0.50, 0.90)  # fixed values: quantile levels
AMOUNT = "decimal(18,6)"  # products of two stay exact in 38 digits
FLAT_TOLERANCE = 1e-9  # relative variance below which plain moments cancel


def _moment(expr: Column, w) -> Column:
    return F.sum(expr).over(w).cast("double")


def spend_response_moments(weekly_df: DataFrame, keys: list[str]) -> DataFrame:
    """Weekly rows with their series' exact moment sums and fitted line."""
    w = Window.partitionBy(*keys)
    # Narrower than MONEY so that products stay exact in 38 digits.
    x, y = F.col("spend").cast("decimal(18,6)"), F.col("revenue").cast("decimal(18,6)")
    # Differences from the smallest value are exact, so spend that varies little keeps all its digits.
    dx = (F.col("x") - F.min("x").over(w)).cast("decimal(18,6)")
    dy = (F.col("y") - F.min("y").over(w)).cast("decimal(18,6)")
    rows = weekly_df.select(*keys, "week", "spend", "revenue", x.alias("x"), y.alias("y"))
    rows = rows.select("*", dx.alias("dx"), dy.alias("dy"))
    x, y, dx, dy = F.col("x"), F.col("y"), F.col("dx"), F.col("dy")
    df = rows.select(
        *keys, "week", "spend", "revenue",
        F.count(F.lit(1)).over(w).alias("n_weeks"),
        _moment(x, w).alias("sx"), _moment(y, w).alias("sy"),
        _moment(x * x, w).alias("sxx"), _moment(x * y, w).alias("sxy"), _moment(y * y, w).alias("syy"),
        _moment(dx, w).alias("cx"), _moment(dy, w).alias("cy"),
        _moment(dx * dx, w).alias("cxx"), _moment(dx * dy, w).alias("cxy"), _moment(dy * dy, w).alias("cyy"),
    )
    return with_line(df).withColumn("ratio", ratio(F.col("spend"), F.col("revenue")))


def centred_moments(train: str) -> dict[str, Column]:
    """Moments of the differences from ``min_x`` and ``min_y``, from an array of weeks with ``x`` and ``y``; weeks without one add nothing."""
    def centred(term: str) -> Column:
        term = term.format(x=f"CAST(t.x - min_x AS {AMOUNT})", y=f"CAST(t.y - min_y AS {AMOUNT})")
        return F.expr(f"CAST(aggregate({train}, CAST(0 AS decimal(37,12)), (total, t) -> "
                      f"CAST(total + coalesce(CAST({term} AS decimal(36,12)), 0) AS decimal(37,12))) AS double)")
    return {"cx": centred("{x}"), "cy": centred("{y}"), "cxx": centred("{x} * {x}"), "cxy": centred("{x} * {y}"), "cyy": centred("{y} * {y}")}


def ratio(spend: Column, revenue: Column) -> Column:
    """Revenue over the fitted value, null where nothing positive is fitted."""
    fitted = F.col("intercept") + F.col("slope") * spend
    return F.when(fitted > 0, revenue / fitted)


def with_line(df: DataFrame, centred: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with slope, intercept and sigma from its moment columns.

    ``centred`` has the moments from the smallest values (cx, cy, cxx, cxy,
    cyy) as expressions; without it they are columns. They are looked at only
    where the plain ones cancel.
    """
    c = centred or {name: F.col(name) for name in ("cx", "cy", "cxx", "cxy", "cyy")}
    n = F.col("n_weeks").cast("double")
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")
    plain = den > F.lit(FLAT_TOLERANCE) * n * F.col("sxx")
    vxx = n * c["cxx"] - c["cx"] * c["cx"]
    vxy = n * c["cxy"] - c["cx"] * c["cy"]
    vyy = n * c["cyy"] - c["cy"] * c["cy"]
    slope = F.when(plain, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / den)
    slope = slope.when(c["cxx"] > 0, vxy / vxx).otherwise(F.lit(0.0))  # some week's spend is above the smallest
    df = df.withColumn("slope", slope)
    df = df.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / n)
    sse = F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")
    sse = F.when(plain & (sse > F.lit(FLAT_TOLERANCE) * F.col("syy")), sse).otherwise((vyy - F.col("slope") * vxy) / n)
    sigma = F.when(F.col("n_weeks") > 2, F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - F.lit(2.0)))).otherwise(F.lit(0.0))
    return df.withColumn("sigma", sigma)


def ratio_quantile(ordered: Column, q: float) -> Column:
    """Quantile of an ascending array by linear interpolation; 1 without values."""
    m = F.size(ordered)
    pos = F.lit(q) * (m - F.lit(1)).cast("double")
    lo = F.floor(pos).cast("int")
    frac = pos - F.floor(pos)
    v_lo, v_hi = F.get(ordered, lo), F.get(ordered, lo + 1)
    return F.when(m == 0, F.lit(1.0)).when(frac == 0, v_lo).otherwise(v_lo + frac * (v_hi - v_lo))


def series_fits(weekly_df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: n_weeks, slope, intercept, sigma and ``ratios``, the ascending array of its ratios.

    One aggregate takes the moments and the weeks of a series together; the
    centred moments are taken from the array, and only where they are needed.
    """
    x, y = F.col("spend").cast(AMOUNT), F.col("revenue").cast(AMOUNT)
    # Dealt by series, so that each gets its array in one place and the rows are not sorted by ratio.
    rows = weekly_df.select(*keys, "spend", "revenue", x.alias("x"), y.alias("y")).repartition(*keys)
    x, y = F.col("x"), F.col("y")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    series = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_weeks"), *[F.sum(e).cast("double").alias(c) for c, e in sums.items()],
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.collect_list(F.struct("spend", "revenue", "x", "y")).alias("train"))
    t = with_line(series, centred_moments("train"))
    ratios = F.transform("train", lambda w: ratio(w["spend"], w["revenue"]))
    return t.select(*keys, "n_weeks", "intercept", "slope", "sigma", F.sort_array(F.array_compact(ratios)).alias("ratios"))


def fit_spend_response(weekly_df: DataFrame, keys: list[str], min_weeks: int = 4) -> DataFrame:
    """One row per series: n_weeks, intercept, slope, sigma, r10, r50, r90, eligible."""
    return banded(series_fits(weekly_df, keys)).drop("ratios").withColumn("eligible", F.col("n_weeks") >= min_weeks)


def banded(fits: DataFrame) -> DataFrame:
    """``fits`` with the quantiles of their ratios."""
    return fits.withColumns({f"r{int(round(q * 100))}": ratio_quantile(F.col("ratios"), q) for q in QUANTILES})


def _clip0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def score_horizon(fit: DataFrame, keys: list[str], requests: DataFrame, spend_col: str = "planned_spend") -> DataFrame:
    """Score both models for each request row (keys, spend, horizon_days).

    Trend role (p_*): weekly fitted value and its ±z·sigma interval, each
    clipped at 0, summed over the future weeks and scaled to the exact window.
    Quantile role (q_*): weekly fitted × ratio bands, clipped at 0 and put in
    order (low ≤ mid ≤ high), summed and scaled. All rounded to 2 dp.
    """
    return score_fitted(requests.join(fit, keys, "left"), spend_col)


def score_fitted(rows: DataFrame, spend_col: str = "planned_spend") -> DataFrame:
    """:func:`score_horizon` on requests that already carry their fit."""
    j = rows.withColumns(horizon_columns(F.col("horizon_days")))
    j = j.withColumn("weekly_spend", weekly_spend(F.col(spend_col), F.col("equivalent_weeks")))
    base = F.col("intercept") + F.col("slope") * F.col("weekly_spend")
    band = F.lit(Z_INTERVAL) * F.col("sigma")
    total = F.col("n_future").cast("double")

    def horizon_total(weekly_value: Column) -> Column:
        return out_round(weekly_value * total * F.col("horizon_scale"))

    qs = F.array_sort(F.array(_clip0(base * F.col("r10")), _clip0(base * F.col("r50")), _clip0(base * F.col("r90"))))
    return j.select(
        "*",
        horizon_total(_clip0(base - band)).alias("p_low"),
        horizon_total(_clip0(base)).alias("p_median"),
        horizon_total(_clip0(base + band)).alias("p_high"),
        horizon_total(F.element_at(qs, 1)).alias("q_low"),
        horizon_total(F.element_at(qs, 2)).alias("q_median"),
        horizon_total(F.element_at(qs, 3)).alias("q_high"),
    )


def ordered_quantiles(low: Column, mid: Column, high: Column) -> tuple[Column, Column, Column]:
    """Clamp three quantile predictions at 0 and sort them."""
    arr = F.array_sort(F.array(_clip0(low), _clip0(mid), _clip0(high)))
    return F.element_at(arr, 1), F.element_at(arr, 2), F.element_at(arr, 3)
