"""SQL oracles for features, models, scenarios and back-tests (DuckDB dialect).

These mirror the column arithmetic of the operators step by step, with every
double constant written as an exact double so both engines compute the same
IEEE values.
"""

from __future__ import annotations

from ..operators import models, scenarios
from .sql import dbl, horizon_sql, rnd


def scenarios_cte(name: str = "sc") -> str:
    vals = ", ".join(f"({sid}, '{ch}', {amt!r}, {h})" for sid, ch, amt, h in scenarios.default_scenario_rows())
    return (f"{name} AS (SELECT CAST(a AS INTEGER) AS scenario_id, b AS channel, CAST(c AS DOUBLE) AS planned_spend, "
            f"CAST(d AS INTEGER) AS horizon_days FROM (VALUES {vals}) t(a, b, c, d))")


def fit_ctes(keys: list[str], src: str = "wk", out: str = "fit", min_weeks: int = 4) -> list[str]:
    k = ", ".join(keys)
    x, y = "CAST(CAST(spend AS DECIMAL(18,6)) AS DECIMAL(38,6))", "CAST(CAST(revenue AS DECIMAL(18,6)) AS DECIMAL(38,6))"
    n = "CAST(n_weeks AS DOUBLE)"
    den = f"({n} * sxx - sx * sx)"
    q_aggs, q_cols = [], []
    for q in models.QUANTILES:
        tag = f"r{int(round(q * 100))}"
        pos = f"({dbl(q)} * CAST(m - 1 AS DOUBLE))"
        q_aggs.append(f"MAX(CASE WHEN rn = FLOOR({pos}) + 1 THEN ratio END) AS {tag}_lo")
        q_aggs.append(f"MAX(CASE WHEN rn = FLOOR({pos}) + 2 THEN ratio END) AS {tag}_hi")
        frac = f"({pos} - FLOOR({pos}))"
        q_cols.append(f"CASE WHEN m = 0 THEN {dbl(1.0)} WHEN {frac} = 0 THEN {tag}_lo "
                      f"ELSE {tag}_lo + {frac} * ({tag}_hi - {tag}_lo) END AS {tag}")
    return [
        f"""{out}_m AS (SELECT {k}, week, spend, revenue, COUNT(*) OVER p AS n_weeks,
              CAST(SUM({x}) OVER p AS DOUBLE) AS sx, CAST(SUM({y}) OVER p AS DOUBLE) AS sy,
              CAST(SUM({x} * {x}) OVER p AS DOUBLE) AS sxx, CAST(SUM({x} * {y}) OVER p AS DOUBLE) AS sxy,
              CAST(SUM({y} * {y}) OVER p AS DOUBLE) AS syy
            FROM {src} WINDOW p AS (PARTITION BY {k}))""",
        f"""{out}_s AS (SELECT *, CASE WHEN n_weeks >= 2 AND {den} > {dbl(models.FLAT_TOLERANCE)} * {n} * sxx
                    THEN ({n} * sxy - sx * sy) / {den} ELSE {dbl(0.0)} END AS slope FROM {out}_m)""",
        f"""{out}_i AS (SELECT *, (sy - slope * sx) / {n} AS intercept FROM {out}_s)""",
        f"""{out}_r AS (SELECT *, CASE WHEN n_weeks > 2
                    THEN sqrt(GREATEST(syy - intercept * sy - slope * sxy, {dbl(0.0)}) / ({n} - {dbl(2.0)}))
                    ELSE {dbl(0.0)} END AS sigma,
                  CASE WHEN intercept + slope * spend > 0 THEN revenue / (intercept + slope * spend) END AS ratio
            FROM {out}_i)""",
        f"""{out}_k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY ratio ASC NULLS LAST) AS rn,
                  COUNT(ratio) OVER (PARTITION BY {k}) AS m FROM {out}_r)""",
        f"""{out}_g AS (SELECT {k}, MAX(n_weeks) AS n_weeks, MAX(intercept) AS intercept, MAX(slope) AS slope,
                  MAX(sigma) AS sigma, MAX(m) AS m, {', '.join(q_aggs)} FROM {out}_k GROUP BY {k})""",
        f"""{out} AS (SELECT {k}, n_weeks, intercept, slope, sigma, {', '.join(q_cols)},
                  n_weeks >= {min_weeks} AS eligible FROM {out}_g)""",
    ]


def score_ctes(keys: list[str], fit: str, req: str, spend_col: str = "planned_spend", out: str = "scored") -> list[str]:
    n, eq, scale = horizon_sql()
    jk = " AND ".join(f"r.{c} = f.{c}" for c in keys)
    z = dbl(models.Z_INTERVAL)
    zero = dbl(0.0)
    base = "(intercept + slope * weekly_spend)"

    def tot(v):
        return rnd(f"{v} * CAST(n_future AS DOUBLE) * horizon_scale")

    def clip(v):
        return f"GREATEST({v}, {zero})"
    qs = f"list_sort([{clip(base + ' * r10')}, {clip(base + ' * r50')}, {clip(base + ' * r90')}])"
    fcols = ", ".join(f"f.{c}" for c in ("n_weeks", "intercept", "slope", "sigma", "r10", "r50", "r90", "eligible"))
    return [
        f"""{out}_h AS (SELECT *, {n} AS n_future, {eq} AS equivalent_weeks, {scale} AS horizon_scale FROM {req})""",
        f"""{out}_w AS (SELECT *, CASE WHEN equivalent_weeks <> 0 THEN CAST({spend_col} AS DOUBLE) / equivalent_weeks
                  ELSE {zero} END AS weekly_spend FROM {out}_h)""",
        f"""{out}_j AS (SELECT r.*, {fcols} FROM {out}_w r LEFT JOIN {fit} f ON {jk})""",
        f"""{out} AS (SELECT *, {tot(clip(f'{base} - {z} * sigma'))} AS p_low, {tot(clip(base))} AS p_median,
                  {tot(clip(f'{base} + {z} * sigma'))} AS p_high,
                  {tot(f'{qs}[1]')} AS q_low, {tot(f'{qs}[2]')} AS q_median, {tot(f'{qs}[3]')} AS q_high
            FROM {out}_j)""",
    ]


def combine_sql(caps: bool, chan: str = "channel") -> tuple[str, str, str]:
    """(low, median, high) SQL over p_*/q_* columns, unrounded."""
    s = scenarios.MIN_SPREAD
    down, up = dbl(1.0 - s), dbl(1.0 + s)
    low_pct = f"(CASE WHEN q_median > 0 THEN LEAST(q_low / q_median, {down}) ELSE {down} END)"
    high_pct = f"(CASE WHEN q_median > 0 THEN GREATEST(q_high / q_median, {up}) ELSE {up} END)"
    l0 = f"LEAST(p_low, p_median * {low_pct})"
    h0 = f"GREATEST(p_high, p_median * {high_pct})"
    l1 = f"(CASE WHEN {l0} > p_median THEN p_median * {down} ELSE {l0} END)"
    h1 = f"(CASE WHEN {h0} < p_median THEN p_median * {up} ELSE {h0} END)"
    if caps and scenarios.BAND_CAPS:
        for ch, (dn, upc) in scenarios.BAND_CAPS.items():
            l1 = (f"(CASE WHEN {chan} = '{ch}' THEN GREATEST({l1}, p_median * ({dbl(1.0)} - {dbl(dn)})) "
                  f"ELSE {l1} END)")
            h1 = (f"(CASE WHEN {chan} = '{ch}' THEN LEAST({h1}, p_median * ({dbl(1.0)} + {dbl(upc)})) "
                  f"ELSE {h1} END)")
    return l1, "p_median", h1


def forecast_ctes(keys: list[str], fit: str, req: str = "sc", out: str = "fc", caps: bool = True) -> list[str]:
    ctes = score_ctes(keys, fit, req, out=f"{out}_sc")
    lo, md, hi = combine_sql(caps)
    zero = dbl(0.0)
    k = ", ".join(keys)

    def roas(c):
        return f"CASE WHEN planned_spend <> 0 THEN {rnd(f'{c} / planned_spend')} ELSE {zero} END"
    ctes += [
        f"""{out}_st AS (SELECT *, CASE WHEN intercept IS NULL THEN 'no_history'
                   WHEN NOT eligible THEN 'insufficient_history'
                   WHEN planned_spend <= 0 THEN 'no_spend' ELSE 'ok' END AS status FROM {out}_sc)""",
        f"""{out}_c AS (SELECT scenario_id, {k}, planned_spend, horizon_days, status,
                  CASE WHEN status = 'ok' THEN {rnd(lo)} ELSE {zero} END AS revenue_low,
                  CASE WHEN status = 'ok' THEN {rnd(md)} ELSE {zero} END AS revenue_median,
                  CASE WHEN status = 'ok' THEN {rnd(hi)} ELSE {zero} END AS revenue_high FROM {out}_st)""",
        f"""{out} AS (SELECT *, {roas('revenue_low')} AS roas_low, {roas('revenue_median')} AS roas_median,
                  {roas('revenue_high')} AS roas_high FROM {out}_c)""",
    ]
    return ctes


def blended_cte(fc: str = "fc", out: str = "bl") -> str:
    zero = dbl(0.0)

    def xs(c):
        return f"COALESCE(CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE), {zero})"

    def roas(c):
        return f"CASE WHEN total_spend <> 0 THEN {rnd(f'{c} / total_spend')} ELSE {zero} END"
    return f"""{out} AS (SELECT *, {roas('revenue_low')} AS roas_low, {roas('revenue_median')} AS roas_median,
              {roas('revenue_high')} AS roas_high FROM (
        SELECT scenario_id, {xs('planned_spend')} AS total_spend, {rnd(xs('revenue_low'))} AS revenue_low,
               {rnd(xs('revenue_median'))} AS revenue_median, {rnd(xs('revenue_high'))} AS revenue_high
        FROM {fc} GROUP BY scenario_id))"""
