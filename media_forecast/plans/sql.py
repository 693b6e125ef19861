"""SQL text helpers for the DuckDB oracles.

The oracle for each query re-derives the vendor exports from ``lineitem`` and
``supplier`` with the same rules as :mod:`media_forecast.sources.fixtures` and
applies the same numeric policy as :mod:`media_forecast.functions`.
"""

from __future__ import annotations

from ..sources.fixtures import NAME_STEMS, TYPE_LABELS


def xsum(c: str) -> str:
    """Exact 4-dp sum, 0.0 when empty."""
    return f"COALESCE(CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE), 0.0)"


def xsum_null(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE)"


def isum(c: str) -> str:
    return f"CAST(COALESCE(SUM({c}), 0) AS BIGINT)"


def ratio(n: str, d: str) -> str:
    return f"COALESCE(CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0), 0.0)"


def rnd(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def row_mean(c: str) -> str:
    return f"({xsum_null(c)} / NULLIF(CAST(COUNT({c}) AS DOUBLE), 0))"


def week(c: str = "date") -> str:
    return f"CAST(date_trunc('week', {c}) AS DATE)"


def sources_text(c: str = "revenue_source") -> str:
    return f"COALESCE(string_agg(DISTINCT {c}, ', ' ORDER BY {c}), '')"


def _case_mod(key: str, labels: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{lab}'" for i, lab in enumerate(labels))
    return f"CASE {key} % {len(labels)} {arms} END"


FIXTURE_CTES = f"""
li AS (
  SELECT CAST(l.l_shipdate AS DATE) AS d, l.l_returnflag AS flag,
         CAST(l.l_suppkey AS VARCHAR) AS cid,
         CASE WHEN l.l_suppkey % 37 = 1 THEN NULL
              ELSE ({_case_mod('l.l_suppkey', NAME_STEMS)}) || ' | ' || s.s_name END AS cname,
         {_case_mod('l.l_suppkey', TYPE_LABELS)} AS ctype,
         l.l_extendedprice * l.l_discount + 0.0 AS spend,
         CASE WHEN l.l_tax = 0 THEN CAST(0.0 AS DOUBLE)
              ELSE l.l_extendedprice * (CAST(1.0 AS DOUBLE) - l.l_discount) END AS revenue,
         CAST(CASE WHEN l.l_linenumber = 7 THEN 0 ELSE CAST(l.l_quantity AS BIGINT) END AS BIGINT) AS clicks,
         CAST(l.l_quantity * 100 + l.l_linenumber AS BIGINT) AS impressions,
         CAST(l.l_linenumber AS DOUBLE) AS conversions,
         l.l_extendedprice / 10 AS budget,
         l.l_extendedprice / 100 AS conv_value,
         l.l_extendedprice * (CAST(1.0 AS DOUBLE) - l.l_discount) AS meta_revenue
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
google AS (
  SELECT d AS date, 'Google' AS channel, cid AS campaign_id, cname AS campaign_name, ctype AS campaign_type,
         CAST(CAST(CAST(spend AS DECIMAL(18,6)) * 1000000 AS BIGINT) AS DOUBLE) / CAST(1000000.0 AS DOUBLE) AS spend,
         revenue, clicks, impressions, conversions, budget AS daily_budget,
         FALSE AS revenue_is_estimated, 'metrics_conversions_value' AS revenue_source
  FROM li WHERE flag = 'A'
),
bing AS (
  SELECT d AS date, 'Bing' AS channel, cid AS campaign_id, cname AS campaign_name, ctype AS campaign_type,
         spend, revenue, clicks, impressions, conversions, budget AS daily_budget,
         FALSE AS revenue_is_estimated, 'Revenue' AS revenue_source
  FROM li WHERE flag = 'N'
),
meta_base AS (
  SELECT d AS date, 'Meta' AS channel, cid AS campaign_id, cname AS campaign_name,
         CASE WHEN contains(lower(cname), 'prospecting') THEN 'Prospecting'
              WHEN contains(lower(cname), 'retargeting') OR contains(lower(cname), 'remarketing') THEN 'Retargeting'
              WHEN contains(lower(cname), 'dpa') THEN 'DPA'
              WHEN contains(lower(cname), 'generic') THEN 'Generic'
              ELSE 'Other' END AS campaign_type,
         spend, clicks, impressions, conversions, CAST(NULL AS DOUBLE) AS daily_budget,
         conv_value, meta_revenue
  FROM li WHERE flag = 'R'
),
meta AS (
  SELECT date, channel, campaign_id, campaign_name, campaign_type, spend,
         spend * CAST(2.0 AS DOUBLE) AS revenue, clicks, impressions, conversions, daily_budget,
         TRUE AS revenue_is_estimated, 'fallback_roas_2' AS revenue_source
  FROM meta_base
),
unified_base AS (
  SELECT * FROM google UNION ALL SELECT * FROM bing UNION ALL SELECT * FROM meta
),
unified AS (
  SELECT *, {ratio('revenue', 'spend')} AS roas, {ratio('spend', 'clicks')} AS cpc,
         {ratio('conversions', 'clicks')} AS cvr
  FROM unified_base
)"""


def with_fixtures(*ctes: str, select: str) -> str:
    """``WITH <fixture views>, <extra ctes> <select>``."""
    parts = [FIXTURE_CTES.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()


UNIFIED_COLS_SQL = ("date, channel, campaign_id, campaign_name, campaign_type, spend, revenue, clicks, "
                    "impressions, conversions, daily_budget, revenue_is_estimated, revenue_source")


def lookback_cte(name: str = "recent", src: str = "unified", days: int = 90) -> str:
    return (f"{name} AS (SELECT * FROM {src} WHERE date >= "
            f"(SELECT MAX(date) FROM {src}) - INTERVAL {days} DAY)")


def dbl(x: float) -> str:
    """A double literal from its exact shortest text (no decimal-literal arithmetic)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def horizon_sql(h: str = "horizon_days") -> tuple[str, str, str]:
    """(n_future, equivalent_weeks, horizon_scale) expressions."""
    eq = f"(CAST({h} AS DOUBLE) / {dbl(7.0)})"
    n = f"CAST(GREATEST(CEIL({eq}), 1) AS INTEGER)"
    return n, eq, f"({eq} / CAST({n} AS DOUBLE))"
