"""Named queries over the driver tables + their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
Queries without an oracle entry are checked by properties (row counts,
ordering invariants) in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grains, kpis, unify as unify_ops
from ..sources import fixtures
from ..sources.vendors import load_channels, meta_to_unified
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared inputs

def unified(spark: SparkSession, sf_dir: str, channels=("Google", "Bing", "Meta")) -> DataFrame:
    raw = fixtures.raw_exports(spark, sf_dir)
    frames = load_channels(spark, {c: raw[c] for c in channels})
    return unify_ops.unify(frames.values(), spark)


U = S.UNIFIED_COLS_SQL
UR = U + ", roas, cpc, cvr"

# ---------------------------------------------------------------------------
# ingest


@register("ingest_google", S.with_fixtures(select=f"SELECT {U} FROM google"))
def q_ingest_google(spark, sf_dir):
    return load_channels(spark, {"Google": fixtures.google_raw(spark, sf_dir)})["Google"]


@register("ingest_bing", S.with_fixtures(select=f"SELECT {U} FROM bing"))
def q_ingest_bing(spark, sf_dir):
    return load_channels(spark, {"Google": None, "Bing": fixtures.bing_raw(spark, sf_dir)}, required=())["Bing"]


@register("ingest_meta", S.with_fixtures(select=f"SELECT {U} FROM meta"))
def q_ingest_meta(spark, sf_dir):
    return meta_to_unified(fixtures.meta_raw(spark, sf_dir))


def _meta_variant_sql(revenue: str, estimated: str, source: str) -> str:
    return S.with_fixtures(select=f"""
SELECT date, channel, campaign_id, campaign_name, campaign_type, spend, {revenue} AS revenue, clicks,
       impressions, conversions, daily_budget, {estimated} AS revenue_is_estimated, '{source}' AS revenue_source
FROM meta_base""")


META_AOV = 45.5


@register("meta_revenue_observed", _meta_variant_sql("meta_revenue", "FALSE", "revenue"))
def q_meta_observed(spark, sf_dir):
    return meta_to_unified(fixtures.meta_raw(spark, sf_dir, "revenue"))


@register("meta_revenue_conv_value", _meta_variant_sql("conversions * conv_value", "FALSE", "conversion_value"))
def q_meta_conv_value(spark, sf_dir):
    return meta_to_unified(fixtures.meta_raw(spark, sf_dir, "conversion_value"))


@register("meta_revenue_aov", _meta_variant_sql(f"conversions * CAST({META_AOV} AS DOUBLE)", "TRUE",
                                                 "estimated_aov_45.5"))
def q_meta_aov(spark, sf_dir):
    return meta_to_unified(fixtures.meta_raw(spark, sf_dir), estimated_aov=META_AOV)


@register("meta_revenue_fallback", _meta_variant_sql("spend * CAST(2.5 AS DOUBLE)", "TRUE", "fallback_roas_2.5"))
def q_meta_fallback(spark, sf_dir):
    return meta_to_unified(fixtures.meta_raw(spark, sf_dir), fallback_roas=2.5)


@register("meta_campaign_type", S.with_fixtures(select="""
SELECT campaign_name, campaign_type, CAST(COUNT(*) AS BIGINT) AS rows
FROM meta GROUP BY ALL"""))
def q_meta_campaign_type(spark, sf_dir):
    m = meta_to_unified(fixtures.meta_raw(spark, sf_dir))
    return m.groupBy("campaign_name", "campaign_type").agg(F.count(F.lit(1)).alias("rows"))


@register("unified_daily", S.with_fixtures(select=f"SELECT {UR} FROM unified"))
def q_unified_daily(spark, sf_dir):
    return unified(spark, sf_dir)


@register("unified_google_only", S.with_fixtures(
    f"g AS (SELECT *, {S.ratio('revenue', 'spend')} AS roas, {S.ratio('spend', 'clicks')} AS cpc, "
    f"{S.ratio('conversions', 'clicks')} AS cvr FROM google)",
    select=f"SELECT {UR} FROM g"))
def q_unified_google_only(spark, sf_dir):
    return unified(spark, sf_dir, channels=("Google",))


_ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in unify_ops.ORDER_KEYS)


@register("preview_first_100", S.with_fixtures(select=f"SELECT {UR} FROM unified ORDER BY {_ORDER_SQL} LIMIT 100"))
def q_preview(spark, sf_dir):
    return unify_ops.preview(unified(spark, sf_dir), 100)


# ---------------------------------------------------------------------------
# weekly series + KPIs


def _weekly_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return S.with_fixtures(
        f"""w AS (SELECT {k}, {S.week()} AS week, {S.xsum('spend')} AS spend, {S.xsum('revenue')} AS revenue,
               {S.isum('clicks')} AS clicks, {S.isum('impressions')} AS impressions,
               {S.xsum('conversions')} AS conversions
        FROM unified WHERE {notnull} AND date IS NOT NULL GROUP BY {k}, {S.week()})""",
        select=f"SELECT *, {S.ratio('revenue', 'spend')} AS roas FROM w")


def weekly_cte(keys: list[str], name: str = "wk", src: str = "unified") -> str:
    k = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    return f"""{name} AS (SELECT *, {S.ratio('revenue', 'spend')} AS roas FROM (
        SELECT {k}, {S.week()} AS week, {S.xsum('spend')} AS spend, {S.xsum('revenue')} AS revenue,
               {S.isum('clicks')} AS clicks, {S.isum('impressions')} AS impressions,
               {S.xsum('conversions')} AS conversions
        FROM {src} WHERE {notnull} AND date IS NOT NULL GROUP BY {k}, {S.week()}))"""


for _grain in ("channel", "campaign_type", "campaign"):
    def _make(g):
        def q(spark, sf_dir):
            return kpis.weekly(unified(spark, sf_dir), g)
        return q
    register(f"weekly_{_grain}", _weekly_sql(kpis.GRAINS[_grain]))(_make(_grain))


def _grain_sql(grain: str, keys: list[str]) -> str:
    """One grain by itself, groups with a missing key included."""
    every = ["channel", "campaign_type", "campaign_id", "campaign_name"]
    cols = ", ".join(k if k in keys else f"CAST(NULL AS VARCHAR) AS {k}" for k in every)
    by = ", ".join([*keys, S.week()])
    missing = " OR ".join(f"{k} IS NULL" for k in keys) or "FALSE"
    return f"""SELECT '{grain}' AS grain, {cols}, {S.week()} AS week, {S.xsum('spend')} AS spend,
       {S.xsum('revenue')} AS revenue, {S.isum('clicks')} AS clicks, {S.isum('impressions')} AS impressions,
       {S.xsum('conversions')} AS conversions, CAST(COUNT(*) AS BIGINT) AS rows, ({missing}) AS key_missing
FROM unified GROUP BY {by}"""


_GRAINS_CTE = "gr AS (" + "\nUNION ALL ".join(
    _grain_sql(g, k) for g, k in [*kpis.GRAINS.items(), ("total", [])]) + ")"


@register("weekly_all_grains", S.with_fixtures(_GRAINS_CTE, select=f"""
SELECT *, {S.ratio('revenue', 'spend')} AS roas FROM gr"""))
def q_weekly_all_grains(spark, sf_dir):
    return grains.weekly_grains(unified(spark, sf_dir))


@register("weekly_left_out", S.with_fixtures(_GRAINS_CTE, select=f"""
SELECT grain, {S.isum('rows')} AS rows, {S.xsum('spend')} AS spend, {S.xsum('revenue')} AS revenue,
       CAST(COALESCE(SUM(rows) FILTER (WHERE key_missing), 0) AS BIGINT) AS rows_without_key,
       {S.xsum('CASE WHEN key_missing THEN spend END')} AS spend_without_key,
       {S.xsum('CASE WHEN key_missing THEN revenue END')} AS revenue_without_key
FROM gr GROUP BY grain"""))
def q_weekly_left_out(spark, sf_dir):
    return grains.left_out(grains.weekly_grains(unified(spark, sf_dir)))


@register("lookback_rows", S.with_fixtures(S.lookback_cte(), select="""
SELECT channel, CAST(COUNT(*) AS BIGINT) AS rows FROM recent WHERE channel IS NOT NULL GROUP BY channel"""))
def q_lookback_rows(spark, sf_dir):
    return kpis.lookback_rows(unified(spark, sf_dir))


@register("channel_metrics", S.with_fixtures(S.lookback_cte(), f"""
a AS (SELECT channel, {S.xsum('spend')} AS total_spend, {S.xsum('revenue')} AS total_revenue,
         {S.isum('clicks')} AS total_clicks, {S.isum('impressions')} AS total_impressions,
         {S.xsum('conversions')} AS total_conversions,
         {S.row_mean('spend')} AS avg_daily_spend, {S.row_mean('revenue')} AS avg_daily_revenue,
         CAST(COUNT(*) FILTER (WHERE COALESCE(revenue_is_estimated, FALSE)) AS BIGINT) AS estimated_revenue_rows,
         CAST(COUNT(*) AS BIGINT) AS rows_in_lookback, {S.sources_text()} AS revenue_source
  FROM recent WHERE channel IS NOT NULL GROUP BY channel)""", select=f"""
SELECT channel, total_spend, total_revenue, total_clicks, total_impressions, total_conversions,
       avg_daily_spend, avg_daily_revenue, estimated_revenue_rows,
       {S.rnd(S.ratio('total_revenue', 'total_spend'))} AS roas,
       {S.rnd(S.ratio('total_spend', 'total_clicks'))} AS cpc,
       {S.rnd(S.ratio('total_conversions', 'total_clicks'))} AS cvr,
       rows_in_lookback, estimated_revenue_rows > 0 AS revenue_is_estimated,
       {S.rnd(S.ratio('estimated_revenue_rows', 'rows_in_lookback'))} AS estimated_revenue_share,
       revenue_source
FROM a"""))
def q_channel_metrics(spark, sf_dir):
    return kpis.channel_metrics(unified(spark, sf_dir))


@register("historical_summary", S.with_fixtures(S.lookback_cte(), f"""
a AS (SELECT channel, {S.xsum('spend')} AS total_spend, {S.xsum('revenue')} AS total_revenue,
         {S.isum('clicks')} AS total_clicks, {S.xsum('conversions')} AS total_conversions,
         {S.row_mean('spend')} AS avg_daily_spend, {S.row_mean('revenue')} AS avg_daily_revenue
  FROM recent WHERE channel IS NOT NULL GROUP BY channel)""",
    """o AS (SELECT CAST(MIN(date) AS VARCHAR) || ' to ' || CAST(MAX(date) AS VARCHAR) AS date_range,
         string_agg(DISTINCT channel, ', ' ORDER BY channel) AS channels FROM unified)""", select=f"""
SELECT channel, {S.rnd('total_spend')} AS total_spend, {S.rnd('total_revenue')} AS total_revenue, total_clicks,
       {S.rnd('total_conversions')} AS total_conversions, {S.rnd('avg_daily_spend')} AS avg_daily_spend,
       {S.rnd('avg_daily_revenue')} AS avg_daily_revenue,
       {S.rnd(S.ratio('total_revenue', 'total_spend'))} AS aggregate_roas,
       {S.rnd(S.ratio('total_spend', 'total_clicks'))} AS cpc,
       {S.rnd(S.ratio('total_conversions', 'total_clicks'))} AS cvr, o.date_range, o.channels
FROM a CROSS JOIN o"""))
def q_historical_summary(spark, sf_dir):
    return kpis.historical_summary(unified(spark, sf_dir))


@register("campaign_history_90d", S.with_fixtures(S.lookback_cte(), select=f"""
SELECT channel, campaign_name, campaign_type, {S.xsum('revenue')} AS historical_revenue,
       {S.xsum('spend')} AS historical_spend,
       CAST(COUNT(*) FILTER (WHERE COALESCE(revenue_is_estimated, FALSE)) AS BIGINT) AS estimated_revenue_rows,
       {S.sources_text()} AS revenue_source
FROM recent WHERE channel IS NOT NULL AND campaign_name IS NOT NULL AND campaign_type IS NOT NULL
GROUP BY channel, campaign_name, campaign_type"""))
def q_campaign_history(spark, sf_dir):
    return kpis.campaign_history(unified(spark, sf_dir))


@register("series_eligibility", S.with_fixtures(weekly_cte(kpis.GRAINS["campaign"]), select="""
SELECT channel, campaign_id, campaign_name, CAST(COUNT(*) AS BIGINT) AS n_weeks, COUNT(*) >= 4 AS eligible
FROM wk GROUP BY channel, campaign_id, campaign_name"""))
def q_series_eligibility(spark, sf_dir):
    keys = kpis.GRAINS["campaign"]
    return kpis.series_eligibility(kpis.weekly(unified(spark, sf_dir), "campaign"), keys)


# ---------------------------------------------------------------------------
# data quality

from ..operators import quality  # noqa: E402

LEAK = "spend > 0 AND revenue = 0"


def _dq(name: str, fn, sql: str):
    register(name, sql)(lambda spark, sf_dir: fn(unified(spark, sf_dir)))


_dq("dq_date_range", quality.date_range, S.with_fixtures(select="""
SELECT channel, MIN(date) AS min_date, MAX(date) AS max_date FROM unified WHERE channel IS NOT NULL GROUP BY channel"""))

_dq("dq_zero_revenue_campaigns", quality.zero_revenue_campaigns, S.with_fixtures(select=f"""
SELECT DISTINCT campaign_name FROM unified WHERE {LEAK}"""))

_dq("dq_zero_revenue_top_spend", quality.zero_revenue_top_spend, S.with_fixtures(
    f"g AS (SELECT channel, campaign_name, {S.xsum('spend')} AS spend FROM unified WHERE {LEAK} "
    "GROUP BY channel, campaign_name)",
    select=f"""SELECT channel, campaign_name, {S.rnd('spend')} AS spend FROM g
ORDER BY spend DESC, channel ASC NULLS FIRST, campaign_name ASC NULLS FIRST LIMIT 10"""))

_DUPS = ("d AS (SELECT channel, campaign_id, date, CAST(COUNT(*) AS BIGINT) AS n_rows FROM unified "
         "GROUP BY channel, campaign_id, date HAVING COUNT(*) > 1)")

_dq("dq_duplicate_keys", quality.duplicate_keys, S.with_fixtures(_DUPS, select="SELECT * FROM d"))

_dq("dq_duplicate_rows", quality.duplicate_rows, S.with_fixtures(_DUPS, select="""
SELECT CAST(COALESCE(SUM(n_rows), 0) AS BIGINT) AS duplicate_rows FROM d"""))

_dq("dq_counts", quality.counts, S.with_fixtures(select=f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_records,
       CAST(COUNT(*) FILTER (WHERE {LEAK}) AS BIGINT) AS zero_revenue_rows,
       CAST(COUNT(DISTINCT CASE WHEN {LEAK} THEN campaign_name END) AS BIGINT) AS zero_revenue_campaign_count,
       CAST(COUNT(*) FILTER (WHERE spend < 0) AS BIGINT) AS negative_spend_rows,
       CAST(COUNT(*) FILTER (WHERE revenue < 0) AS BIGINT) AS negative_revenue_rows,
       CAST(COUNT(*) FILTER (WHERE COALESCE(revenue_is_estimated, FALSE)) AS BIGINT) AS estimated_revenue_rows,
       CAST(COUNT(*) FILTER (WHERE spend = 0) AS BIGINT) AS zero_spend_rows,
       CAST(COUNT(*) FILTER (WHERE spend > 0 AND revenue / spend > 50) AS BIGINT) AS extreme_roas_rows
FROM unified"""))

_dq("dq_record_counts", quality.record_counts, S.with_fixtures(select="""
SELECT channel, CAST(COUNT(*) AS BIGINT) AS records FROM unified WHERE channel IS NOT NULL GROUP BY channel"""))

_MISSING_COLS = ["date", "channel", "campaign_id", "campaign_name", "campaign_type", "spend", "revenue", "clicks",
                 "impressions", "conversions", "daily_budget", "revenue_is_estimated", "revenue_source",
                 "roas", "cpc", "cvr"]
_dq("dq_missing_values", quality.missing_values, S.with_fixtures(
    "m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing_count "
        "FROM unified" for c in _MISSING_COLS) + ")",
    select="SELECT * FROM m WHERE missing_count > 0"))

_OBS = "obs AS (SELECT DISTINCT channel, date FROM unified WHERE channel IS NOT NULL AND date IS NOT NULL)"

_dq("dq_missing_dates", quality.missing_dates, S.with_fixtures(_OBS, """
cal AS (SELECT channel, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date
        FROM obs GROUP BY channel)""", select="""
SELECT c.channel, c.date AS missing_date FROM cal c ANTI JOIN obs o ON c.channel = o.channel AND c.date = o.date"""))

_dq("dq_missing_date_counts", quality.missing_date_counts, S.with_fixtures(_OBS, select="""
SELECT channel, CAST(datediff('day', MIN(date), MAX(date)) + 1 - COUNT(*) AS BIGINT) AS missing_dates
FROM obs GROUP BY channel"""))

_dq("dq_coverage_mismatch", quality.coverage_mismatch, S.with_fixtures(select="""
SELECT channel, CAST(datediff('day', (SELECT MIN(date) FROM unified), MIN(date)) AS INTEGER)
                AS starts_after_global_min_days,
       CAST(datediff('day', MAX(date), (SELECT MAX(date) FROM unified)) AS INTEGER) AS ends_before_global_max_days
FROM unified WHERE channel IS NOT NULL GROUP BY channel"""))

_dq("dq_estimated_by_channel", quality.estimated_by_channel, S.with_fixtures(select="""
SELECT channel, CAST(COUNT(*) AS BIGINT) AS estimated_rows FROM unified
WHERE channel IS NOT NULL AND COALESCE(revenue_is_estimated, FALSE) GROUP BY channel"""))

register("dq_revenue_sources", S.with_fixtures(select=f"""
SELECT channel, {S.sources_text()} AS sources_text FROM unified WHERE channel IS NOT NULL GROUP BY channel"""))(
    lambda spark, sf_dir: quality.revenue_sources(unified(spark, sf_dir)).select("channel", "sources_text"))

_dq("dq_zero_spend_by_channel", quality.zero_spend_by_channel, S.with_fixtures(select="""
SELECT channel, CAST(COUNT(*) AS BIGINT) AS zero_spend_rows FROM unified
WHERE channel IS NOT NULL AND spend = 0 GROUP BY channel"""))

_dq("dq_extreme_roas_top", quality.extreme_roas_top, S.with_fixtures(
    "p AS (SELECT *, revenue / spend AS row_roas FROM unified WHERE spend > 0)",
    select=f"""
SELECT channel, campaign_name, strftime(date, '%Y-%m-%d') AS date, {S.rnd('spend')} AS spend,
       {S.rnd('revenue')} AS revenue, {S.rnd('row_roas')} AS row_roas
FROM p WHERE row_roas > 50
ORDER BY p.row_roas DESC, channel ASC NULLS FIRST, campaign_name ASC NULLS FIRST, p.date ASC NULLS FIRST,
         campaign_id ASC NULLS FIRST, p.spend DESC
LIMIT 10"""))

_dq("estimated_channels", quality.estimated_channels, S.with_fixtures(select="""
SELECT DISTINCT channel FROM unified WHERE channel IS NOT NULL AND COALESCE(revenue_is_estimated, FALSE)"""))


# ---------------------------------------------------------------------------
# features, models, scenarios

from ..operators import features, models, pooled_bands, scenarios  # noqa: E402
from . import model_sql as M  # noqa: E402

CH = ["channel"]
CAMP = kpis.GRAINS["campaign"]


def weekly_of(spark, sf_dir, grain="channel"):
    return kpis.weekly(unified(spark, sf_dir), grain)


def _features_sql(keys):
    k = ", ".join(keys)
    mean = "CAST(SUM(CAST(spend AS DECIMAL(28,6))) OVER p AS DOUBLE) / CAST(COUNT(spend) OVER p AS DOUBLE)"
    roll = ("CAST(SUM(CAST(spend AS DECIMAL(28,6))) OVER r AS DOUBLE) / CAST(COUNT(spend) OVER r AS DOUBLE)")
    return S.with_fixtures(weekly_cte(keys), select=f"""
SELECT *, CAST(month(week) AS INTEGER) AS month, CAST(quarter(week) AS INTEGER) AS quarter,
       CAST(weekofyear(week) AS INTEGER) AS week_of_year,
       COALESCE(LAG(spend, 1) OVER o, {mean}) AS spend_lag1,
       COALESCE(LAG(spend, 4) OVER o, {mean}) AS spend_lag4,
       {roll} AS spend_rolling4
FROM wk
WINDOW p AS (PARTITION BY {k}), o AS (PARTITION BY {k} ORDER BY week),
       r AS (PARTITION BY {k} ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")


@register("features_weekly", _features_sql(CAMP))
def q_features_weekly(spark, sf_dir):
    return features.build_features(weekly_of(spark, sf_dir, "campaign"), CAMP)


@register("promo_flags", S.with_fixtures(weekly_cte(CH), select="""
SELECT *, CAST(weekofyear(week) AS INTEGER) AS week_of_year,
       CAST(CAST(weekofyear(week) AS INTEGER) BETWEEN 47 AND 50 AS INTEGER) AS is_promo FROM wk"""))
def q_promo_flags(spark, sf_dir):
    return features.promo_flags(weekly_of(spark, sf_dir))


_N, _EQ, _SCALE = S.horizon_sql()


@register("future_week_grid", S.with_fixtures(weekly_cte(CH), M.scenarios_cte(), f"""
g AS (SELECT l.channel, h.horizon_days, l.last_week, {_N} AS n_future, {_EQ} AS equivalent_weeks,
             {_SCALE} AS horizon_scale
      FROM (SELECT channel, MAX(week) AS last_week FROM wk GROUP BY channel) l
      CROSS JOIN (SELECT DISTINCT horizon_days FROM sc) h)""", """
e AS (SELECT *, CAST(unnest(generate_series(1, n_future)) AS INTEGER) AS step FROM g)""", select="""
SELECT channel, horizon_days, step, n_future, equivalent_weeks, horizon_scale,
       CAST(last_week + 7 * step AS DATE) AS week FROM e"""))
def q_future_week_grid(spark, sf_dir):
    return features.future_week_grid(weekly_of(spark, sf_dir), CH, scenarios.default_scenarios(spark))


def _future_features_sql():
    tails = ", ".join(
        f"COALESCE(CAST(SUM(CASE WHEN rn <= {j} THEN CAST(spend AS DECIMAL(28,6)) END) AS DOUBLE), 0.0) AS tail{j}"
        for j in range(1, 5))
    w_fut = "LEAST(step - 1, 4)"
    h_hist = f"LEAST(n_hist, 4 - {w_fut})"
    tail_sum = (f"CASE WHEN {h_hist} = 1 THEN tail1 WHEN {h_hist} = 2 THEN tail2 WHEN {h_hist} = 3 THEN tail3 "
                f"WHEN {h_hist} = 4 THEN tail4 ELSE {S.dbl(0.0)} END")
    cnt = f"({w_fut} + {h_hist})"
    mean4 = (f"CASE WHEN {cnt} > 0 THEN ({tail_sum} + {w_fut} * weekly_spend) / CAST({cnt} AS DOUBLE) "
             "ELSE weekly_spend END")
    return S.with_fixtures(weekly_cte(CH), M.scenarios_cte(), f"""
rk AS (SELECT channel, week, spend, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY week DESC) AS rn FROM wk)""",
                           f"""
tl AS (SELECT channel, COUNT(*) AS n_hist, MAX(week) AS last_week, MAX(CASE WHEN rn = 1 THEN spend END) AS last_spend,
              {tails} FROM rk GROUP BY channel)""", f"""
s1 AS (SELECT *, {_N} AS n_future, {_EQ} AS equivalent_weeks, {_SCALE} AS horizon_scale FROM sc)""", f"""
s2 AS (SELECT *, CASE WHEN equivalent_weeks <> 0 THEN planned_spend / equivalent_weeks ELSE {S.dbl(0.0)} END
              AS weekly_spend FROM s1)""", """
e AS (SELECT s2.*, tl.n_hist, tl.last_week, tl.last_spend, tl.tail1, tl.tail2, tl.tail3, tl.tail4,
             CAST(unnest(generate_series(1, n_future)) AS INTEGER) AS step
      FROM s2 JOIN tl ON s2.channel = tl.channel)""", select=f"""
SELECT scenario_id, channel, horizon_days, step, CAST(last_week + 7 * step AS DATE) AS week, weekly_spend AS spend,
       CAST(month(CAST(last_week + 7 * step AS DATE)) AS INTEGER) AS month,
       CAST(quarter(CAST(last_week + 7 * step AS DATE)) AS INTEGER) AS quarter,
       CAST(weekofyear(CAST(last_week + 7 * step AS DATE)) AS INTEGER) AS week_of_year,
       CASE WHEN step = 1 AND n_hist > 0 THEN last_spend ELSE weekly_spend END AS spend_lag1,
       {mean4} AS spend_lag4, {mean4} AS spend_rolling4, horizon_scale
FROM e""")


@register("future_features", _future_features_sql())
def q_future_features(spark, sf_dir):
    return features.future_features(weekly_of(spark, sf_dir), CH, scenarios.default_scenarios(spark))


@register("spend_response_fit", S.with_fixtures(weekly_cte(CAMP), *M.fit_ctes(CAMP), select="""
SELECT channel, campaign_id, campaign_name, n_weeks, intercept, slope, sigma, eligible FROM fit"""))
def q_spend_response_fit(spark, sf_dir):
    return models.fit_spend_response(weekly_of(spark, sf_dir, "campaign"), CAMP).select(
        *CAMP, "n_weeks", "intercept", "slope", "sigma", "eligible")


@register("residual_bands", S.with_fixtures(weekly_cte(CH), *M.fit_ctes(CH), select="""
SELECT channel, r10, r50, r90 FROM fit"""))
def q_residual_bands(spark, sf_dir):
    return models.fit_spend_response(weekly_of(spark, sf_dir), CH).select("channel", "r10", "r50", "r90")


SERIES = ["channel", "campaign_type", "campaign_id", "campaign_name"]
POOL_WEEKS, POOL_SIZE = 156, 4000  # three years and a size so that given campaigns lie on both sides of them


def _pool_ctes() -> list[str]:
    """Sketches of the ratios of each pool, from the rows themselves, and the values at the ranks."""
    g = S.dbl(pooled_bands.growth())
    lng = S.dbl(pooled_bands.math.log(pooled_bands.growth()))
    mid = S.dbl(2.0 / (pooled_bands.growth() + 1.0))
    out = [f"""pv AS (SELECT channel, campaign_type, CASE WHEN ratio = 0 THEN {S.dbl(0.0)}
        ELSE sign(ratio) * {mid} * pow({g}, ceil(ln(abs(ratio)) / {lng})) END AS v
        FROM fit_r WHERE ratio IS NOT NULL)"""]
    for i, pool in enumerate(pooled_bands.POOLS):
        k = "".join(f"{c}, " for c in pool)
        by = f"PARTITION BY {', '.join(pool)}" if pool else ""
        picks = ", ".join(
            f"MAX(CASE WHEN rn = FLOOR({S.dbl(q)} * CAST(m - 1 AS DOUBLE)) + 1 THEN v END) AS {b}"
            for b, q in pooled_bands.BANDS.items())
        out.append(f"""pool{i} AS (SELECT {k} MAX(m) AS m, {picks} FROM (
            SELECT *, ROW_NUMBER() OVER ({by} ORDER BY v) AS rn, COUNT(*) OVER ({by}) AS m FROM pv)
            {'GROUP BY ' + ', '.join(pool) if pool else ''})""")
    return out


def _pool_pick(c: str, last: str) -> str:
    arms = " ".join(f"WHEN p{i}.m >= {POOL_SIZE} THEN {c.format(i=i)}" for i in range(3))
    return f"CASE {arms} ELSE {last} END"


_W = f"LEAST(CAST(f.n_weeks AS DOUBLE) / {S.dbl(POOL_WEEKS)}, {S.dbl(1.0)})"


@register("pooled_bands", S.with_fixtures(weekly_cte(SERIES), *M.fit_ctes(SERIES), *_pool_ctes(), select=f"""
SELECT f.channel, f.campaign_type, f.campaign_id, f.campaign_name, f.n_weeks,
       CASE WHEN p0.m >= {POOL_SIZE} THEN 'channel+campaign_type' WHEN p1.m >= {POOL_SIZE} THEN 'channel'
            WHEN p2.m >= {POOL_SIZE} THEN 'all' ELSE 'none' END AS pool,
       CAST({_pool_pick('p{i}.m', '0')} AS BIGINT) AS pool_values, {S.rnd(_W, 6)} AS own_weight,
       {', '.join(S.rnd(f"CASE WHEN {_W} >= 1 THEN f.{b} ELSE {_W} * f.{b} + ({S.dbl(1.0)} - {_W}) * "
                        + _pool_pick('p{i}.' + b, S.dbl(1.0)) + " END", 6) + f" AS {b}" for b in pooled_bands.BANDS)}
FROM fit f LEFT JOIN pool0 p0 ON f.channel = p0.channel AND f.campaign_type = p0.campaign_type
LEFT JOIN pool1 p1 ON f.channel = p1.channel LEFT JOIN pool2 p2 ON TRUE"""))
def q_pooled_bands(spark, sf_dir):
    return pooled_bands.pooled_bands(weekly_of(spark, sf_dir, SERIES), SERIES, full_weeks=POOL_WEEKS, min_pool=POOL_SIZE)


def _scored(spark, sf_dir):
    fit = models.fit_spend_response(weekly_of(spark, sf_dir), CH)
    return models.score_horizon(fit, CH, scenarios.default_scenarios(spark))


_SCORED_SQL = [weekly_cte(CH), *M.fit_ctes(CH), M.scenarios_cte(), *M.score_ctes(CH, "fit", "sc")]
_REQ = "scenario_id, channel, planned_spend, horizon_days"


@register("spend_response_forecast", S.with_fixtures(*_SCORED_SQL, select=f"""
SELECT {_REQ}, p_low, p_median, p_high FROM scored"""))
def q_spend_response_forecast(spark, sf_dir):
    return _scored(spark, sf_dir).select(*_REQ.split(", "), "p_low", "p_median", "p_high")


@register("ordered_quantiles", S.with_fixtures(*_SCORED_SQL, select=f"""
SELECT {_REQ}, q_low, q_median, q_high FROM scored"""))
def q_ordered_quantiles(spark, sf_dir):
    return _scored(spark, sf_dir).select(*_REQ.split(", "), "q_low", "q_median", "q_high")


_LO, _MD, _HI = M.combine_sql(caps=False)


@register("combine_bands", S.with_fixtures(*_SCORED_SQL, select=f"""
SELECT {_REQ}, p_low, p_median, p_high, q_low, q_median, q_high,
       {S.rnd(_LO)} AS revenue_low, {S.rnd(_MD)} AS revenue_median, {S.rnd(_HI)} AS revenue_high
FROM scored WHERE intercept IS NOT NULL"""))
def q_combine_bands(spark, sf_dir):
    s = _scored(spark, sf_dir).filter(F.col("intercept").isNotNull())
    comb = scenarios.combine_bands(*[F.col(c) for c in ("p_low", "p_median", "p_high", "q_low", "q_median", "q_high")])
    return s.select(*_REQ.split(", "), "p_low", "p_median", "p_high", "q_low", "q_median", "q_high",
                    *[c.alias(n) for n, c in comb.items()])


def forecast_of(spark, sf_dir):
    fit = models.fit_spend_response(weekly_of(spark, sf_dir), CH)
    return scenarios.scenario_forecast(fit, scenarios.default_scenarios(spark), CH)


_FC_SQL = [weekly_cte(CH), *M.fit_ctes(CH), M.scenarios_cte(), *M.forecast_ctes(CH, "fit")]


@register("scenario_forecast", S.with_fixtures(*_FC_SQL, select="SELECT * FROM fc"))
def q_scenario_forecast(spark, sf_dir):
    return forecast_of(spark, sf_dir)


@register("scenario_blended", S.with_fixtures(*_FC_SQL, M.blended_cte(), select="SELECT * FROM bl"))
def q_scenario_blended(spark, sf_dir):
    return scenarios.blended(forecast_of(spark, sf_dir))


def _roas_sql(q: str) -> str:
    return (f"CASE WHEN planned_spend <> 0 THEN {S.rnd(f'revenue_{q} / planned_spend')} "
            f"ELSE {S.dbl(0.0)} END AS roas_{q}")


@register("scenario_with_blended", S.with_fixtures(*_FC_SQL, M.blended_cte(), select=f"""
SELECT scenario_id, channel, FALSE AS blended, planned_spend AS total_spend, revenue_low, revenue_median, revenue_high,
       {', '.join(_roas_sql(q) for q in ('low', 'median', 'high'))} FROM fc
UNION ALL
SELECT scenario_id, NULL, TRUE, total_spend, revenue_low, revenue_median, revenue_high,
       roas_low, roas_median, roas_high FROM bl"""))
def q_scenario_with_blended(spark, sf_dir):
    return grains.with_blended(forecast_of(spark, sf_dir))


_PCT = (f"CASE WHEN revenue_median > 0 THEN (revenue_high - revenue_low) / revenue_median * {S.dbl(100.0)} "
        f"ELSE {S.dbl(0.0)} END")


@register("risk_uncertainty", S.with_fixtures(*_FC_SQL, M.blended_cte(), select=f"""
SELECT scenario_id, {S.rnd(_PCT)} AS uncertainty_pct,
       CASE WHEN {_PCT} > 40 THEN 'HIGH' WHEN {_PCT} > 20 THEN 'MODERATE' ELSE 'LOW' END AS uncertainty_level
FROM bl"""))
def q_risk_uncertainty(spark, sf_dir):
    return scenarios.risk_uncertainty(scenarios.blended(forecast_of(spark, sf_dir)))


@register("risk_channel_alerts", S.with_fixtures(*_FC_SQL, select="""
SELECT scenario_id, channel, roas_low,
       CASE WHEN roas_low < 1 THEN 'below_break_even' WHEN roas_low < 2 THEN 'below_target' ELSE 'healthy' END AS alert
FROM fc"""))
def q_risk_channel_alerts(spark, sf_dir):
    return scenarios.channel_alerts(forecast_of(spark, sf_dir))


@register("forecast_range", S.with_fixtures(*_FC_SQL, M.blended_cte(), select=f"""
SELECT scenario_id, channel, revenue_low, {S.rnd('revenue_high - revenue_low')} AS band, revenue_median FROM fc
UNION ALL
SELECT scenario_id, 'blended' AS channel, revenue_low, {S.rnd('revenue_high - revenue_low')} AS band, revenue_median
FROM bl"""))
def q_forecast_range(spark, sf_dir):
    return grains.range_table(grains.with_blended(forecast_of(spark, sf_dir)))


@register("roas_long", S.with_fixtures(*_FC_SQL, select="""
SELECT scenario_id, channel, 'roas_low' AS quantile, roas_low AS roas FROM fc
UNION ALL SELECT scenario_id, channel, 'roas_median', roas_median FROM fc
UNION ALL SELECT scenario_id, channel, 'roas_high', roas_high FROM fc"""))
def q_roas_long(spark, sf_dir):
    return scenarios.roas_long(forecast_of(spark, sf_dir))


@register("budget_share", S.with_fixtures(*_FC_SQL, select=f"""
SELECT scenario_id, channel, planned_spend,
       CASE WHEN t <> 0 THEN {S.rnd('planned_spend / t', 4)} ELSE {S.dbl(0.0)} END AS share
FROM (SELECT *, CAST(SUM(CAST(planned_spend AS DECIMAL(28,6))) OVER (PARTITION BY scenario_id) AS DOUBLE) AS t
      FROM fc)"""))
def q_budget_share(spark, sf_dir):
    return scenarios.budget_share(forecast_of(spark, sf_dir))


# ---------------------------------------------------------------------------
# back-test, allocation

from ..operators import allocation, backtest  # noqa: E402

BT_H, BT_W = backtest.DEFAULT_HORIZON, backtest.DEFAULT_WINDOWS


def _bt_sql(*extra, select, keys=CH):
    k = ", ".join(keys)
    dk = ", ".join(f"d.{c}" for c in keys)
    on = " AND ".join(f"d.{c} = w.{c}" for c in keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    wk_keys = [*keys, "window_index"]
    return S.with_fixtures(
        f"""dd AS (SELECT {k}, date, {S.xsum('spend')} AS spend, {S.xsum('revenue')} AS revenue FROM unified
              WHERE {notnull} AND date IS NOT NULL GROUP BY {k}, date)""",
        f"""bw AS (SELECT {k}, window_index, CAST(max_date - {BT_H} * window_index - ({BT_H} - 1) AS DATE)
                AS window_start, CAST(max_date - {BT_H} * window_index AS DATE) AS window_end
              FROM (SELECT {k}, MAX(date) AS max_date FROM dd GROUP BY {k}) m,
                   (SELECT CAST(unnest(generate_series(0, {BT_W - 1})) AS INTEGER) AS window_index) i)""",
        f"""act AS (SELECT {dk}, w.window_index, w.window_end, {S.xsum('d.revenue')} AS actual,
                  {S.xsum('d.spend')} AS actual_spend
              FROM dd d JOIN bw w ON {on} AND d.date BETWEEN w.window_start AND w.window_end
              GROUP BY {dk}, w.window_index, w.window_end)""",
        f"""tw AS (SELECT {dk}, w.window_index, {S.week('d.date')} AS week, {S.xsum('d.spend')} AS spend,
                  {S.xsum('d.revenue')} AS revenue
              FROM dd d JOIN bw w ON {on} AND d.date < w.window_start
              GROUP BY {dk}, w.window_index, {S.week('d.date')})""",
        *M.fit_ctes(wk_keys, src="tw", out="bfit"),
        f"req AS (SELECT *, {BT_H} AS horizon_days FROM act)",
        *M.score_ctes(wk_keys, "bfit", "req", spend_col="actual_spend", out="bsc"),
        f"""runs AS (SELECT {k}, window_end, actual, {S.rnd(_LO)} AS p10, {S.rnd(_MD)} AS p50,
                  {S.rnd(_HI)} AS p90 FROM bsc WHERE intercept IS NOT NULL)""",
        *extra, select=select)


def _score_sql(keys):
    k = ", ".join(keys)
    return _bt_sql(f"""
sg AS (SELECT {k}, list_sort(list({_ERR}) FILTER (WHERE {_ERR} IS NOT NULL)) AS errs,
              CAST(COUNT(*) FILTER (WHERE p10 <= actual AND actual <= p90) AS BIGINT) AS covered,
              CAST(COUNT(*) AS BIGINT) AS windows_tested FROM runs GROUP BY {k})""", select=f"""
SELECT {k},
       {S.rnd(f"CASE WHEN len(errs) > 0 THEN list_reduce(list_prepend({S.dbl(0.0)}, errs), lambda a, x: a + x) / CAST(len(errs) AS DOUBLE) ELSE {S.dbl(0.0)} END", 4)} AS aape,
       {S.rnd('CAST(covered AS DOUBLE) / CAST(windows_tested AS DOUBLE)', 4)} AS coverage_prob, windows_tested
FROM sg""", keys=keys)


_ERR = "CASE WHEN actual > 0 THEN abs(actual - p50) / actual END"


register("backtest_windows", _bt_sql(select="SELECT * FROM bw"))(
    lambda spark, sf_dir: backtest.windows(backtest.series_daily(unified(spark, sf_dir), CH), CH, BT_H, BT_W))


@register("backtest_actuals", _bt_sql(select="SELECT * FROM act"))
def q_backtest_actuals(spark, sf_dir):
    return backtest.actuals(backtest.series_daily(unified(spark, sf_dir), CH), CH, BT_H, BT_W)


@register("backtest_train_weekly", _bt_sql(select="SELECT * FROM tw"))
def q_backtest_train_weekly(spark, sf_dir):
    return backtest.train_weekly(backtest.series_daily(unified(spark, sf_dir), CH), CH, BT_H, BT_W)


@register("backtest_runs", _bt_sql(select="SELECT * FROM runs"))
def q_backtest_runs(spark, sf_dir):
    return backtest.runs(unified(spark, sf_dir), CH, BT_H, BT_W)


@register("backtest_score", _score_sql(CH))
def q_backtest_score(spark, sf_dir):
    return backtest.score(backtest.runs(unified(spark, sf_dir), CH, BT_H, BT_W), CH)


@register("backtest_score_campaign", _score_sql(CAMP))
def q_backtest_score_campaign(spark, sf_dir):
    """Every campaign series × window refitted and scored in one job."""
    return backtest.score(backtest.runs(unified(spark, sf_dir), CAMP, BT_H, BT_W), CAMP)


@register("campaign_allocation", S.with_fixtures(
    *_FC_SQL, S.lookback_cte(), f"""
camp AS (SELECT channel, campaign_name, campaign_type, {S.xsum('revenue')} AS historical_revenue,
                {S.xsum('spend')} AS historical_spend,
                CAST(COUNT(*) FILTER (WHERE COALESCE(revenue_is_estimated, FALSE)) AS BIGINT) AS est_rows,
                {S.sources_text()} AS revenue_source
         FROM recent WHERE channel IS NOT NULL AND campaign_name IS NOT NULL AND campaign_type IS NOT NULL
         GROUP BY channel, campaign_name, campaign_type)""", """
cw AS (SELECT *, CAST(SUM(CAST(historical_revenue AS DECIMAL(28,6))) OVER (PARTITION BY channel) AS DOUBLE) AS ch_revenue,
              CAST(SUM(CAST(historical_spend AS DECIMAL(28,6))) OVER (PARTITION BY channel) AS DOUBLE) AS ch_spend
       FROM camp)""", f"""
j AS (SELECT cw.*, f.scenario_id, f.revenue_median AS ch_forecast, f.channel IS NOT NULL AS has_fc
      FROM cw LEFT JOIN (SELECT scenario_id, channel, revenue_median FROM fc) f
      ON cw.channel = f.channel)""", select=f"""
SELECT scenario_id, channel, campaign_name, campaign_type, historical_spend, historical_revenue,
       CASE WHEN NOT has_fc THEN NULL
            WHEN ch_revenue > 0 THEN historical_revenue / ch_revenue * ch_forecast
            WHEN ch_spend > 0 THEN historical_spend / ch_spend * ch_forecast ELSE {S.dbl(0.0)} END AS forecast_revenue,
       CASE WHEN NOT has_fc THEN NULL WHEN ch_revenue > 0 THEN 'Revenue share'
            WHEN ch_spend > 0 THEN 'Spend share' ELSE 'No spend/revenue' END AS allocation_basis,
       est_rows > 0 AS revenue_is_estimated, revenue_source
FROM j"""))
def q_campaign_allocation(spark, sf_dir):
    return allocation.ranked(allocation.allocate(unified(spark, sf_dir), forecast_of(spark, sf_dir)))


# ---------------------------------------------------------------------------
# learned models (level ii) — property-checked, no SQL oracle

from ..operators import series_models  # noqa: E402


@register("trend_fit")
def q_trend_fit(spark, sf_dir):
    return series_models.fit_trend(weekly_of(spark, sf_dir, "campaign"), CAMP)


@register("quantile_fit")
def q_quantile_fit(spark, sf_dir):
    return series_models.fit_quantile(weekly_of(spark, sf_dir, "campaign"), CAMP)


@register("trend_forecast")
def q_trend_forecast(spark, sf_dir):
    fit = series_models.fit_trend(weekly_of(spark, sf_dir), CH)
    return series_models.trend_forecast(fit, CH, scenarios.default_scenarios(spark))


@register("quantile_forecast")
def q_quantile_forecast(spark, sf_dir):
    wk = weekly_of(spark, sf_dir)
    fit = series_models.fit_quantile(wk, CH)
    future = features.future_features(wk, CH, scenarios.default_scenarios(spark))
    return series_models.quantile_forecast(fit, CH, future)


def learned_forecast(spark, sf_dir, keys=CH, scen=None):
    """Scenario scoring with the learned models: trend median, quantile spread."""
    wk = weekly_of(spark, sf_dir, "channel" if keys == CH else "campaign")
    sc = scen if scen is not None else scenarios.default_scenarios(spark)
    req = [*sc.columns]
    p = series_models.trend_forecast(series_models.fit_trend(wk, keys), keys, sc)
    q = series_models.quantile_forecast(series_models.fit_quantile(wk, keys), keys,
                                        features.future_features(wk, keys, sc))
    elig = kpis.series_eligibility(wk, keys)
    j = (sc.join(p.drop("planned_spend"), ["scenario_id", *keys, "horizon_days"], "left")
         .join(q, ["scenario_id", *keys, "horizon_days"], "left")
         .join(elig, keys, "left"))
    j = j.withColumn("status", scenarios.history_status(F.col("n_weeks").isNotNull(),
                                                        F.coalesce(F.col("eligible"), F.lit(False))))
    return scenarios.finalize(j.select(*req, "status", "p_low", "p_median", "p_high", "q_low", "q_median", "q_high"),
                              keys)


register("scenario_forecast_learned")(lambda spark, sf_dir: learned_forecast(spark, sf_dir))


# ---------------------------------------------------------------------------
# campaign-grain scenarios derived from the data (scale case for scoring)

CAMPAIGN_MULTIPLIERS = (0.8, 1.0, 1.2)
CAMPAIGN_HORIZON = 90


def campaign_scenarios(df: DataFrame) -> DataFrame:
    """One scenario per multiplier: each campaign's look-back spend × multiplier over 90 days."""
    hist = kpis.lookback(df).filter(kpis.keys_present(CAMP)).groupBy(*CAMP).agg(
        kpis.exact_sum("spend").alias("hist_spend"))
    mult = df.sparkSession.createDataFrame([(i + 1, float(m)) for i, m in enumerate(CAMPAIGN_MULTIPLIERS)],
                                           "scenario_id int, multiplier double")
    return hist.crossJoin(F.broadcast(mult)).select(
        "scenario_id", *CAMP, (F.col("hist_spend") * F.col("multiplier")).alias("planned_spend"),
        F.lit(CAMPAIGN_HORIZON).alias("horizon_days"))


def _campaign_sc_sql() -> str:
    vals = ", ".join(f"({i + 1}, {m!r})" for i, m in enumerate(CAMPAIGN_MULTIPLIERS))
    return f"""sc AS (SELECT m.scenario_id, h.channel, h.campaign_id, h.campaign_name,
                  h.hist_spend * m.multiplier AS planned_spend, {CAMPAIGN_HORIZON} AS horizon_days
           FROM (SELECT channel, campaign_id, campaign_name, {S.xsum('spend')} AS hist_spend FROM recent
                 WHERE channel IS NOT NULL AND campaign_id IS NOT NULL AND campaign_name IS NOT NULL
                 GROUP BY channel, campaign_id, campaign_name) h
           CROSS JOIN (SELECT CAST(a AS INTEGER) AS scenario_id, CAST(b AS DOUBLE) AS multiplier
                       FROM (VALUES {vals}) t(a, b)) m)"""


@register("campaign_scenario_forecast", S.with_fixtures(
    weekly_cte(CAMP), *M.fit_ctes(CAMP), S.lookback_cte(), _campaign_sc_sql(), *M.forecast_ctes(CAMP, "fit"),
    select="SELECT * FROM fc"))
def q_campaign_scenario_forecast(spark, sf_dir):
    df = unified(spark, sf_dir)
    fit = models.fit_spend_response(kpis.weekly(df, "campaign"), CAMP)
    return scenarios.scenario_forecast(fit, campaign_scenarios(df), CAMP)


# ---------------------------------------------------------------------------
# narrative context rows

from ..operators import text  # noqa: E402


@register("prompt_rows")
def q_prompt_rows(spark, sf_dir):
    df = unified(spark, sf_dir)
    fit = models.fit_spend_response(kpis.weekly(df, "channel"), CH)
    fc = scenarios.scenario_forecast(fit, scenarios.default_scenarios(spark), CH)
    return text.prompt_rows(df, fc, scenarios.blended(fc))


# ---------------------------------------------------------------------------
# connectors: CSV export → reader, Parquet sink → reader (round trips through
# the shared checkpoint folder named by the session)

import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import read_unified, write_unified  # noqa: E402
from ..functions import exact_sum, safe_ratio  # noqa: E402
from ..operators import stored_checks  # noqa: E402
from ..sources import month_store  # noqa: E402
from ..sources.export_source import load_vendor_export  # noqa: E402
from ..sources.sinks import export_csv, read_parsed, read_sorted, write_parsed, write_sorted  # noqa: E402
from ..sources.vendors import load_bing, load_google, load_lenient, load_meta  # noqa: E402


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("ingest_csv_roundtrip", S.with_fixtures(select=f"""
SELECT {U} FROM google UNION ALL SELECT {U} FROM bing UNION ALL SELECT {U} FROM meta"""))
def q_ingest_csv_roundtrip(spark, sf_dir):
    paths = {}
    for ch, raw in fixtures.raw_exports(spark, sf_dir).items():
        paths[ch] = _scratch(spark, f"export-{ch.lower()}")
        export_csv(raw, paths[ch])
    return (load_google(spark, paths["Google"]).unionByName(load_bing(spark, paths["Bing"]))
            .unionByName(load_meta(spark, paths["Meta"])))


@register("ingest_source_roundtrip", ORACLE["ingest_csv_roundtrip"])
def q_ingest_source_roundtrip(spark, sf_dir):
    """The three exports as CSV, read by the data source whose tasks read the headers."""
    frames = []
    for ch, raw in fixtures.raw_exports(spark, sf_dir).items():
        path = _scratch(spark, f"source-{ch.lower()}")
        export_csv(raw, path)
        frames.append(load_vendor_export(spark, ch, path))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_DIRTY_CTE = """dirty AS (SELECT *, list_filter([
         CASE WHEN k % 11 = 3 THEN 'TimePeriod: not a date' END, CASE WHEN k % 13 = 5 THEN 'Clicks: not a whole number' END,
         CASE WHEN k % 19 = 7 THEN 'Revenue: not a number' END, CASE WHEN k % 23 = 4 THEN 'Impressions: not a number' END],
         lambda x: x IS NOT NULL) AS reasons
       FROM (SELECT *, CAST(campaign_id AS BIGINT) AS k FROM bing))"""


def _dirty_parsed(spark, sf_dir):
    """The dirty export as CSV, parsed and written once; good rows and rejects."""
    exported, parsed = _scratch(spark, "export-dirty"), _scratch(spark, "parsed")
    export_csv(fixtures.dirty_bing_raw(spark, sf_dir), exported)
    write_parsed(load_lenient(spark, "Bing", exported), parsed)
    return read_parsed(spark, parsed)


@register("ingest_dirty_csv", S.with_fixtures(_DIRTY_CTE, select="""
SELECT CASE WHEN k % 29 = 6 THEN NULL ELSE date END AS date, channel, campaign_id, campaign_name, campaign_type,
       CASE WHEN k % 17 = 2 THEN NULL ELSE spend END AS spend, revenue, clicks, impressions,
       CASE WHEN k % 31 = 9 THEN NULL ELSE conversions END AS conversions, daily_budget, revenue_is_estimated, revenue_source
FROM dirty WHERE len(reasons) = 0"""))
def q_ingest_dirty_csv(spark, sf_dir):
    """Good rows of an export with missing tokens and unreadable values; the others are rejects."""
    return _dirty_parsed(spark, sf_dir)[0]


@register("ingest_rejects", S.with_fixtures(_DIRTY_CTE, select="""
SELECT channel, reason, CAST(COUNT(*) AS BIGINT) AS rows FROM (SELECT channel, unnest(reasons) AS reason FROM dirty)
GROUP BY channel, reason"""))
def q_ingest_rejects(spark, sf_dir):
    """Rejected rows by reason; a row with several faults counts under each."""
    rejects = _dirty_parsed(spark, sf_dir)[1]
    return (rejects.select("channel", F.explode("reject_reasons").alias("reason"))
            .groupBy("channel", "reason").agg(F.count(F.lit(1)).alias("rows")))


_EDGE_TEXTS = ["", "NaN", "abc", "0", "-0.0", "1e3", "4"]


@register("safe_ratio_edge_cases", f"""
WITH t AS (SELECT l_linenumber - 1 AS n, l_suppkey % 7 AS d, l_extendedprice AS p FROM lineitem),
v AS (SELECT *, list_extract({_EDGE_TEXTS!r}, CAST(n + 1 AS INTEGER)) AS num, list_extract({_EDGE_TEXTS!r}, CAST(d + 1 AS INTEGER)) AS den FROM t),
c AS (SELECT *, TRY_CAST(num AS DOUBLE) AS a, TRY_CAST(den AS DOUBLE) AS b FROM v),
r AS (SELECT num, den, CASE WHEN a IS NULL OR b IS NULL OR isnan(a) OR isnan(b) OR b = 0 THEN 0.0 ELSE a / b END AS text_ratio,
             CASE WHEN b IS NULL OR isnan(b) OR b = 0 THEN 0.0 ELSE p / b END AS price_ratio FROM c)
SELECT num, den, CAST(COUNT(*) AS BIGINT) AS rows, MIN(text_ratio) AS least, MAX(text_ratio) AS most, MAX(price_ratio) AS most_price FROM r GROUP BY num, den""")
def q_safe_ratio_edge_cases(spark, sf_dir):
    """Safe ratios of every pair of empty, non-numeric, NaN, zero and usual texts, over all of lineitem."""
    texts = F.array(*[F.lit(t) for t in _EDGE_TEXTS])
    li = fixtures.table(spark, sf_dir, "lineitem").select(
        F.get(texts, (F.col("l_linenumber") - 1).cast("int")).alias("num"), F.get(texts, (F.col("l_suppkey") % 7).cast("int")).alias("den"),
        "l_extendedprice")
    rows = li.select("num", "den", safe_ratio("num", "den").alias("r"), safe_ratio("l_extendedprice", "den").alias("p"))
    return rows.groupBy("num", "den").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("least"), F.max("r").alias("most"),
                                          F.max("p").alias("most_price"))


@register("unified_parquet_roundtrip", S.with_fixtures(select=f"SELECT {UR} FROM unified"))
def q_unified_parquet_roundtrip(spark, sf_dir):
    path = _scratch(spark, "unified")
    write_unified(unified(spark, sf_dir), path)
    return read_unified(spark, path)


# ---------------------------------------------------------------------------
# month store: deliveries by channel, restated months, reports from stored checks


def _delivery(spark, sf_dir, channel):
    """The unified rows of one channel's export."""
    frames = load_channels(spark, {channel: fixtures.raw_exports(spark, sf_dir)[channel]}, required=())
    return unify_ops.unify(frames.values(), spark)


def _month_store(spark, sf_dir):
    """A store filled by one delivery per channel."""
    root = _scratch(spark, "months")
    for channel in fixtures.CHANNEL_FLAGS:
        month_store.deliver(_delivery(spark, sf_dir, channel), root)
    return root


def _store_quality_sql() -> str:
    parts = [f"SELECT '{c}' AS check, CAST(NULL AS VARCHAR) AS part, {c} AS value FROM cnt" for c in quality.SCALAR_CHECKS]
    parts += [f"SELECT 'missing_values', '{c}', CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM unified "
              f"HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0" for c in _MISSING_COLS]
    for name, key in [("record_counts", "records"), ("missing_date_counts", "missing_dates"),
                      ("coverage_mismatch", "starts_after_global_min_days"), ("coverage_mismatch", "ends_before_global_max_days")]:
        parts.append(f"SELECT '{key}', channel, CAST({key} AS BIGINT) FROM ({ORACLE['dq_' + name]})")
    return f"WITH cnt AS ({ORACLE['dq_counts']}), rows AS ({S.with_fixtures(select='SELECT * FROM unified')}) " + " UNION ALL ".join(
        x.replace("FROM unified", "FROM rows") if x.startswith("SELECT 'missing_values'") else x for x in parts)


@register("store_quality", _store_quality_sql())
def q_store_quality(spark, sf_dir):
    """The reports of the stored checks in long form: counts, missing values by column, coverage by channel."""
    checks = month_store.checks_of(spark, _month_store(spark, sf_dir))
    total = stored_checks.counts(checks).unpivot([], quality.SCALAR_CHECKS, "check", "value").withColumn("part", F.lit(None).cast("string"))
    missing = stored_checks.missing_values(checks).select(
        F.lit("missing_values").alias("check"), F.col("column_name").alias("part"), F.col("missing_count").alias("value"))
    days = ["missing_dates", "starts_after_global_min_days", "ends_before_global_max_days"]
    cover = stored_checks.coverage(checks).select("channel", *[F.col(c).cast("long").alias(c) for c in days])
    per = stored_checks.record_counts(checks).unpivot(["channel"], ["records"], "check", "value").unionByName(
        cover.unpivot(["channel"], days, "check", "value"))
    return total.unionByName(missing).unionByName(per.withColumnRenamed("channel", "part"))


@register("store_channel_metrics", ORACLE["channel_metrics"])
def q_store_channel_metrics(spark, sf_dir):
    """Channel KPIs of the look-back window, from the folders of its months only."""
    recent, as_of = month_store.lookback_of(spark, _month_store(spark, sf_dir))
    return kpis.channel_metrics(recent, as_of=as_of)


RESTATED = "1995-03"


@register("store_restated_month", S.with_fixtures(select=f"""
SELECT channel, strftime(date, '%Y-%m') AS month, CAST(COUNT(*) AS BIGINT) AS rows,
       {S.xsum(f"CASE WHEN channel = 'Bing' AND strftime(date, '%Y-%m') = '{RESTATED}' THEN revenue * 2 ELSE revenue END")} AS revenue
FROM unified GROUP BY ALL"""))
def q_store_restated_month(spark, sf_dir):
    """Revenue by month after one month of one channel was delivered again with other figures."""
    root = _month_store(spark, sf_dir)
    again = _delivery(spark, sf_dir, "Bing").where(stored_checks.month_of() == RESTATED)
    month_store.deliver(again.withColumn("revenue", F.col("revenue") * 2), root, [RESTATED])
    return (month_store.rows_of(spark, root).groupBy("channel", stored_checks.month_of().alias("month"))
            .agg(F.count(F.lit(1)).alias("rows"), exact_sum("revenue").alias("revenue")))


@register("unified_sorted", S.with_fixtures(select=f"""
SELECT {UR}, CAST(ROW_NUMBER() OVER (ORDER BY {_ORDER_SQL}) AS BIGINT) AS position FROM unified"""))
def q_unified_sorted(spark, sf_dir):
    """The whole unified table published in order of date and channel; each row with its position."""
    path = _scratch(spark, "sorted")
    write_sorted(unified(spark, sf_dir), path, unify_ops.ORDER_KEYS)
    return read_sorted(spark, path)


def _summary_sql() -> str:
    overall = " UNION ALL ".join(
        f"SELECT '{c}' AS check, CAST(NULL AS VARCHAR) AS channel, CAST({c} AS BIGINT) AS value FROM cnt"
        for c in quality.SCALAR_CHECKS + ["duplicate_rows"])
    return S.with_fixtures(_DUPS, _OBS, f"""
cnt AS (SELECT CAST(COUNT(*) AS BIGINT) AS total_records,
       CAST(COUNT(*) FILTER (WHERE {LEAK}) AS BIGINT) AS zero_revenue_rows,
       CAST(COUNT(DISTINCT CASE WHEN {LEAK} THEN campaign_name END) AS BIGINT) AS zero_revenue_campaign_count,
       CAST(COUNT(*) FILTER (WHERE spend < 0) AS BIGINT) AS negative_spend_rows,
       CAST(COUNT(*) FILTER (WHERE revenue < 0) AS BIGINT) AS negative_revenue_rows,
       CAST(COUNT(*) FILTER (WHERE COALESCE(revenue_is_estimated, FALSE)) AS BIGINT) AS estimated_revenue_rows,
       CAST(COUNT(*) FILTER (WHERE spend = 0) AS BIGINT) AS zero_spend_rows,
       CAST(COUNT(*) FILTER (WHERE spend > 0 AND revenue / spend > 50) AS BIGINT) AS extreme_roas_rows,
       (SELECT CAST(COALESCE(SUM(n_rows), 0) AS BIGINT) FROM d) AS duplicate_rows
  FROM unified)""", select=f"""
{overall}
UNION ALL SELECT 'records', channel, CAST(COUNT(*) AS BIGINT) FROM unified WHERE channel IS NOT NULL GROUP BY channel
UNION ALL SELECT 'missing_dates', channel, CAST(datediff('day', MIN(date), MAX(date)) + 1 - COUNT(*) AS BIGINT)
          FROM obs GROUP BY channel
UNION ALL SELECT 'zero_spend_rows', channel, CAST(COUNT(*) AS BIGINT) FROM unified
          WHERE channel IS NOT NULL AND spend = 0 GROUP BY channel
UNION ALL SELECT 'estimated_rows', channel, CAST(COUNT(*) AS BIGINT) FROM unified
          WHERE channel IS NOT NULL AND COALESCE(revenue_is_estimated, FALSE) GROUP BY channel
UNION ALL SELECT 'starts_after_global_min_days', channel,
          CAST(datediff('day', (SELECT MIN(date) FROM unified), MIN(date)) AS BIGINT)
          FROM unified WHERE channel IS NOT NULL GROUP BY channel
UNION ALL SELECT 'ends_before_global_max_days', channel,
          CAST(datediff('day', MAX(date), (SELECT MAX(date) FROM unified)) AS BIGINT)
          FROM unified WHERE channel IS NOT NULL GROUP BY channel""")


_dq("dq_validation_summary", quality.validation_summary, _summary_sql())
