"""Edge cases on small literal frames: ratios, calendar, ingest, bands, scoring."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from media_forecast.functions import campaign_type_from_name, out_round, safe_ratio, week_start
from media_forecast.operators import allocation, backtest, features, kpis, models, quality, scenarios, unify
from media_forecast.sources import load_channels, read_unified, write_unified
from media_forecast.sources.schema import UNIFIED_COLUMNS, UNIFIED_SCHEMA


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_safe_ratio_edge_cases(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (-1.0, 2.0), (3.0, 4.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_ratio("n", "d")).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, -0.5, 0.75]


def test_out_round_half_up(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (-0.125,), (1234.5678,)], "x double")
    got = [r[0] for r in df.select(out_round("x", 2)).collect()]
    assert got == [2.68, 0.13, -0.13, 1234.57]


@pytest.mark.parametrize("name,expected", [
    (None, "Other"), ("", "Other"), ("Spring PROSPECTING", "Prospecting"),
    ("remarketing list", "Retargeting"), ("Retargeting DPA", "Retargeting"), ("dpa feed", "DPA"),
    ("generic search", "Generic"), ("Brand", "Other"), ("prospecting + dpa", "Prospecting"),
])
def test_campaign_type(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(campaign_type_from_name("n")).first()[0] == expected


def test_week_start_and_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),), (dt.date(2024, 12, 30),),
                                (dt.date(2021, 1, 3),)], "d date")
    got = df.select(week_start("d").alias("w"), F.weekofyear("d").alias("iso")).collect()
    assert [r.w for r in got] == [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 12, 30),
                                  dt.date(2020, 12, 28)]
    assert [r.iso for r in got] == [1, 2, 1, 53]


def _write_csv(path, header, lines):
    with open(path, "w") as fh:
        fh.write(header + "\n")
        for line in lines:
            fh.write(line + "\n")


def test_dirty_csv_ingest(spark, tmp_path):
    g = tmp_path / "google.csv"
    _write_csv(g, "extra,metrics_cost_micros,segments_date,campaign_id,campaign_name,"
               "campaign_advertising_channel_type,metrics_conversions_value,metrics_clicks,metrics_impressions,"
               "metrics_conversions,campaign_budget_amount",
               ["x,2500000,2024-01-07,123456789012345678,Brand,SEARCH,10.5,5,100,1.0,NA",
                "y,NaN,2024-01-08,,null,SEARCH,,0,,n/a,20"])
    u = load_channels(spark, {"Google": str(g)})["Google"]
    assert u.columns == UNIFIED_COLUMNS
    r = u.orderBy("date").collect()
    assert r[0].spend == 2.5 and r[0].campaign_id == "123456789012345678" and r[0].daily_budget is None
    assert r[1].spend is None and r[1].campaign_id == "nan" and r[1].campaign_name is None
    assert r[1].revenue is None and r[1].impressions is None and r[1].conversions is None


def test_meta_revenue_ladder(spark, tmp_path):
    base = "date_start,campaign_id,campaign_name,spend,clicks,impressions,conversion,daily_budget"
    line = "2024-01-01,1,generic test,10,2,100,3,"
    variants = {
        "revenue": (base + ",revenue", line + ",40", (40.0, False, "revenue")),
        "conv": (base + ",conversion_value", line + ",5", (15.0, False, "conversion_value")),
        "plain": (base, line, (20.0, True, "fallback_roas_2")),
    }
    for key, (header, row, expected) in variants.items():
        p = tmp_path / f"meta_{key}.csv"
        _write_csv(p, header, [row])
        u = load_channels(spark, {"Google": None, "Meta": str(p)}, required=())["Meta"]
        r = u.first()
        assert (r.revenue, r.revenue_is_estimated, r.revenue_source) == expected
        assert r.campaign_type == "Generic"
    p = tmp_path / "meta_plain.csv"
    u = load_channels(spark, {"Meta": str(p)}, required=(), meta_options={"estimated_aov": 12.5})["Meta"]
    assert (u.first().revenue, u.first().revenue_source) == (37.5, "estimated_aov_12.5")


def test_required_channel_missing(spark):
    with pytest.raises(ValueError):
        load_channels(spark, {"Bing": None})


def test_unify_empty_and_sink(spark, tmp_path):
    assert unify.unify([None, None], spark).count() == 0
    day = [(dt.date(2024, 1, 1), "Google", "1", "a", "SEARCH", 10.0, 20.0, 4, 100, 1.0, None, False, "x"),
           (dt.date(2024, 1, 2), "Bing", "2", "b", "SEARCH", 0.0, 5.0, 0, 10, 0.0, 3.0, False, "y")]
    df = unify.with_ratios(spark.createDataFrame(day, ",".join(
        f"{f.name} {f.dataType.simpleString()}" for f in UNIFIED_SCHEMA.fields[:13])))
    assert rows(df.orderBy("date"), "roas", "cpc", "cvr") == [(2.0, 2.5, 0.25), (0.0, 0.0, 0.0)]
    out = str(tmp_path / "unified")
    write_unified(df, out)
    back = read_unified(spark, out)
    assert {"channel=Bing", "channel=Google"} <= set(os.listdir(out))
    assert back.filter(F.col("channel") == "Google").count() == 1


def _daily(spark, data):
    schema = "date date, channel string, campaign_id string, campaign_name string, campaign_type string, " \
             "spend double, revenue double, clicks long, impressions long, conversions double, " \
             "daily_budget double, revenue_is_estimated boolean, revenue_source string"
    return unify.with_ratios(spark.createDataFrame(data, schema))


def test_quality_gaps_duplicates_and_leaks(spark):
    d = dt.date(2024, 1, 1)
    data = [
        (d, "Google", "1", "A", "S", 10.0, 0.0, 1, 10, 1.0, None, False, "g"),
        (d, "Google", "1", "A", "S", 5.0, 600.0, 1, 10, 1.0, None, False, "g"),
        (d + dt.timedelta(days=3), "Google", "2", None, "S", -0.0, 0.0, 0, 10, 0.0, None, False, "g"),
        (d + dt.timedelta(days=1), "Meta", "3", "B", "S", 1.0, 2.0, 1, 10, 0.0, None, True, "fallback_roas_2"),
    ]
    df = _daily(spark, data)
    c = quality.counts(df).first()
    assert (c.total_records, c.zero_revenue_rows, c.zero_spend_rows, c.extreme_roas_rows) == (4, 1, 1, 1)
    assert quality.duplicate_rows(df).first()[0] == 2
    md = {r.channel: r.missing_dates for r in quality.missing_date_counts(df).collect()}
    assert md == {"Google": 2, "Meta": 0}
    assert sorted(r.missing_date for r in quality.missing_dates(df).collect()) == [
        d + dt.timedelta(days=1), d + dt.timedelta(days=2)]
    cov = {r.channel: (r.starts_after_global_min_days, r.ends_before_global_max_days)
           for r in quality.coverage_mismatch(df).collect()}
    assert cov == {"Google": (0, 0), "Meta": (1, 2)}
    mv = {r.column_name: r.missing_count for r in quality.missing_values(df).collect()}
    assert mv == {"campaign_name": 1, "daily_budget": 4}
    assert [r.channel for r in quality.estimated_channels(df).collect()] == ["Meta"]


def test_combine_bands_branches(spark):
    cases = [
        # p_low, p_mid, p_high, q_low, q_mid, q_high, cap?  -> low, mid, high
        (90.0, 100.0, 110.0, 0.0, 0.0, 0.0, False, (85.0, 100.0, 115.0)),    # qM = 0
        (90.0, 100.0, 110.0, 50.0, 100.0, 200.0, False, (50.0, 100.0, 200.0)),  # wide q band
        (99.0, 100.0, 101.0, 98.0, 100.0, 102.0, False, (85.0, 100.0, 115.0)),  # narrow → min spread
        (120.0, 100.0, 90.0, 95.0, 100.0, 105.0, False, (85.0, 100.0, 115.0)),  # L > M and H < M
        (10.0, 100.0, 300.0, 10.0, 100.0, 300.0, True, (65.0, 100.0, 145.0)),   # caps
    ]
    df = spark.createDataFrame([c[:7] for c in cases], "pl double, pm double, ph double, ql double, qm double, "
                                                       "qh double, cap boolean")
    down = F.when(F.col("cap"), F.lit(0.35))
    up = F.when(F.col("cap"), F.lit(0.45))
    comb = scenarios.combine_bands(*[F.col(c) for c in ("pl", "pm", "ph", "ql", "qm", "qh")],
                                   max_downside=down, max_upside=up)
    got = [tuple(r) for r in df.select(*comb.values()).collect()]
    assert got == [c[7] for c in cases]


def test_ordered_quantiles(spark):
    df = spark.createDataFrame([(-1.0, 5.0, 3.0), (9.0, 2.0, 2.0), (4.0, 4.0, 4.0)], "a double, b double, c double")
    lo, mid, hi = models.ordered_quantiles(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in df.select(lo, mid, hi).collect()] == [(0.0, 3.0, 5.0), (2.0, 2.0, 9.0),
                                                                    (4.0, 4.0, 4.0)]


def _weekly_series(spark, n, slope=2.0, intercept=100.0, channel="Google"):
    start = dt.date(2024, 1, 1)
    data = [(channel, start + dt.timedelta(weeks=i), float(10 + (i % 5) * 3),
             intercept + slope * float(10 + (i % 5) * 3)) for i in range(n)]
    return spark.createDataFrame(data, "channel string, week date, spend double, revenue double")


def test_fit_recovers_line_and_scores(spark):
    w = _weekly_series(spark, 20)
    fit = models.fit_spend_response(w, ["channel"]).first()
    assert fit.slope == pytest.approx(2.0) and fit.intercept == pytest.approx(100.0)
    assert fit.sigma == pytest.approx(0.0, abs=1e-6) and fit.r50 == pytest.approx(1.0)
    sc = spark.createDataFrame([(1, "Google", 700.0, 70)], scenarios.SCENARIO_SCHEMA)
    fc = scenarios.scenario_forecast(models.fit_spend_response(w, ["channel"]), sc).first()
    # 10 weeks of 70/wk spend → weekly revenue 100 + 2*70 = 240 → 2400
    assert fc.revenue_median == 2400.0 and fc.status == "ok"
    assert fc.revenue_low <= fc.revenue_median <= fc.revenue_high


def test_fit_of_spend_that_varies_little(spark):
    start = dt.date(2024, 1, 1)
    rows = [("a", start + dt.timedelta(weeks=i), 1e6 + i, 3e9 + 2 * (1e6 + i) + (0.01 if i % 2 else -0.01)) for i in range(60)]
    rows += [("b", start + dt.timedelta(weeks=i), 1e6, 5.0 + i % 2) for i in range(60)]
    w = spark.createDataFrame(rows, "channel string, week date, spend double, revenue double")
    fit = {r.channel: r for r in models.fit_spend_response(w, ["channel"]).collect()}
    assert fit["a"].slope == pytest.approx(2.0, abs=1e-4) and fit["a"].sigma == pytest.approx(0.01, rel=0.05)
    assert fit["b"].slope == 0.0 and fit["b"].intercept == pytest.approx(5.5) and fit["b"].sigma == pytest.approx((15 / 58) ** 0.5)


def test_scenario_zero_rows_and_blend(spark):
    w = _weekly_series(spark, 3).unionByName(_weekly_series(spark, 10, channel="Bing"))
    fit = models.fit_spend_response(w, ["channel"])
    sc = spark.createDataFrame([(1, "Google", 100.0, 30), (1, "Bing", 0.0, 30), (1, "Bing2", 10.0, 30),
                                (2, "Bing", 500.0, 60)], scenarios.SCENARIO_SCHEMA)
    fc = scenarios.scenario_forecast(fit, sc)
    st = {(r.scenario_id, r.channel): r.status for r in fc.collect()}
    assert st == {(1, "Google"): "insufficient_history", (1, "Bing"): "no_spend", (1, "Bing2"): "no_history",
                  (2, "Bing"): "ok"}
    bl = {r.scenario_id: r for r in scenarios.blended(fc).collect()}
    assert bl[1].total_spend == 110.0 and bl[1].revenue_median == 0.0 and bl[1].roas_median == 0.0
    assert bl[2].revenue_median == fc.filter("scenario_id = 2").first().revenue_median


def test_future_features_closed_form(spark):
    w = _weekly_series(spark, 2)  # history spends 10, 13
    sc = spark.createDataFrame([(1, "Google", 6 * 20.0, 42)], scenarios.SCENARIO_SCHEMA)  # 6 weeks at 20/wk
    ff = features.future_features(w, ["channel"], sc).orderBy("step").collect()
    assert [r.spend_lag1 for r in ff] == [13.0, 20.0, 20.0, 20.0, 20.0, 20.0]
    # step1: mean(10,13); step2: mean(10,13,20); step3: (10,13,20,20); step4: (13,20,20,20); then 20
    assert [r.spend_lag4 for r in ff] == [11.5, 43 / 3, 15.75, 18.25, 20.0, 20.0]


def test_backtest_score_edges(spark):
    runs = spark.createDataFrame([
        ("G", 0.0, 0.0, 1.0, 2.0), ("G", 100.0, 90.0, 110.0, 120.0), ("G", 100.0, 80.0, 90.0, 95.0),
        ("B", 0.0, 1.0, 2.0, 3.0)], "channel string, actual double, p10 double, p50 double, p90 double")
    got = {r.channel: (r.aape, r.coverage_prob, r.windows_tested) for r in backtest.score(runs).collect()}
    assert got == {"G": (0.1, 0.6667, 3), "B": (0.0, 0.0, 1)}
    assert backtest.score(runs.limit(0)).count() == 0


def test_allocation_bases(spark):
    d = dt.date(2024, 1, 1)
    data = [(d, "Google", "1", "A", "S", 10.0, 30.0, 1, 1, 1.0, None, False, "g"),
            (d, "Google", "2", "B", "S", 10.0, 10.0, 1, 1, 1.0, None, False, "g"),
            (d, "Bing", "3", "C", "S", 30.0, 0.0, 1, 1, 1.0, None, False, "b"),
            (d, "Bing", "4", "D", "S", 10.0, 0.0, 1, 1, 1.0, None, False, "b"),
            (d, "Meta", "5", "E", "S", 0.0, 0.0, 1, 1, 1.0, None, True, "m"),
            (d, "Other", "6", "F", "S", 5.0, 5.0, 1, 1, 1.0, None, False, "o")]
    df = _daily(spark, data)
    fc = spark.createDataFrame([("Google", 100.0), ("Bing", 40.0), ("Meta", 7.0)], "channel string, revenue_median double")
    got = {r.campaign_name: (r.forecast_revenue, r.allocation_basis)
           for r in allocation.allocate(df, fc).collect()}
    assert got == {"A": (75.0, "Revenue share"), "B": (25.0, "Revenue share"), "C": (30.0, "Spend share"),
                   "D": (10.0, "Spend share"), "E": (0.0, "No spend/revenue"), "F": (None, None)}


def test_lookback_inclusive(spark):
    d = dt.date(2024, 4, 1)
    data = [(d - dt.timedelta(days=k), "Google", "1", "A", "S", 1.0, 1.0, 1, 1, 1.0, None, False, "g")
            for k in range(0, 100)]
    assert kpis.lookback(_daily(spark, data), 90).count() == 91
