"""Mergeable sketches keep their bound; short series shrink towards the right pool, long ones keep their exact band."""

import datetime as dt
import math
import random

import pytest

from media_forecast.operators import models, pooled_bands

KEYS = ["channel", "campaign_type", "campaign_id"]
BANDS = ("r10", "r50", "r90")


def test_quantiles_keep_the_bound_and_sketches_merge(spark):
    r = random.Random(3)
    values = [(g, v) for g in ("a", "b") for v in
              [r.lognormvariate(0, 4) for _ in range(900)] + [-r.lognormvariate(0, 2) for _ in range(80)] + [0.0] * 7 + [1e-300, 1e300]]
    df = spark.createDataFrame([*values, ("a", None), ("b", math.nan), ("c", None)], "g string, ratio double")
    wanted = {f"q{k}": k / 20 for k in range(21)}
    whole = pooled_bands.sketch(df, ["g"])
    got = {x.g: x for x in pooled_bands.quantiles(whole, ["g"], wanted).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        ordered = sorted(v for h, v in values if h == g)
        assert got[g]["values"] == len(ordered)
        for name, q in wanted.items():
            exact = ordered[math.floor(q * (len(ordered) - 1))]
            assert abs(got[g][name] - exact) <= pooled_bands.ACCURACY * abs(exact) * (1 + 1e-9)
    parts = df.randomSplit([1.0, 2.0, 3.0], seed=1)
    merged = pooled_bands.sketch(parts[2], ["g"]).union(pooled_bands.sketch(parts[0], ["g"])).union(pooled_bands.sketch(parts[1], ["g"]))
    assert sorted(pooled_bands.merge(merged, ["g"]).collect()) == sorted(whole.collect())
    everything = pooled_bands.quantiles(pooled_bands.merge(whole, []), []).collect()
    assert len(everything) == 1 and everything[0]["values"] == len(values)
    assert whole.count() < len(values)


def weekly(spark, sizes):
    r = random.Random(8)
    rows = [(ch, ty, c, dt.date(2024, 1, 1) + dt.timedelta(weeks=k), 100.0 + 7 * (k * k % 11), 300.0 + r.randint(0, 200))
            for (ch, ty, c), n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "channel string, campaign_type string, campaign_id string, week date, spend double, revenue double")


def test_short_series_take_the_first_pool_that_is_large_enough(spark):
    sizes = {("g", "s", "long"): 30, ("g", "s", "short"): 6, ("g", "d", "lone"): 5, ("b", "s", "other"): 9, ("b", "s", "one"): 1}
    df = weekly(spark, sizes)
    got = {x.campaign_id: x for x in pooled_bands.pooled_bands(df, KEYS).collect()}
    own = {x.campaign_id: x for x in models.fit_spend_response(df, KEYS).collect()}
    assert {c: x.pool for c, x in got.items()} == {
        "long": "channel+campaign_type", "short": "channel+campaign_type", "lone": "channel", "other": "all", "one": "all"}
    assert {c: x.pool_values for c, x in got.items()} == {"long": 36, "short": 36, "lone": 41, "other": 51, "one": 51}
    assert [got["long"][b] for b in BANDS] == [round(own["long"][b], 6) for b in BANDS] and got["long"].own_weight == 1.0
    ratios = {x: [] for x in ("s", "all")}
    for x in models.spend_response_moments(df, KEYS).collect():
        ratios["all"].append(x.ratio)
        if (x.channel, x.campaign_type) == ("g", "s"):
            ratios["s"].append(x.ratio)
    for c, pool in (("short", "s"), ("other", "all"), ("one", "all")):
        w = sizes[next(k for k in sizes if k[2] == c)] / 12
        assert got[c].own_weight == round(w, 6)
        for b, q in pooled_bands.BANDS.items():
            exact = sorted(ratios[pool])[math.floor(q * (len(ratios[pool]) - 1))]
            assert abs(got[c][b] - (w * own[c][b] + (1 - w) * exact)) <= pooled_bands.ACCURACY * exact + 1e-6
        assert got[c].r10 <= got[c].r50 <= got[c].r90


def test_empty_small_and_wrong_input(spark):
    df = weekly(spark, {("g", "s", "only"): 3})
    assert pooled_bands.pooled_bands(df.limit(0), KEYS).collect() == []
    only = pooled_bands.pooled_bands(df, KEYS).first()
    assert (only.pool, only.pool_values, only.own_weight) == ("none", 0, 0.25)
    with pytest.raises(ValueError):
        pooled_bands.pooled_bands(df, KEYS, pools=[["channel"], ["campaign_type"]])
    with pytest.raises(ValueError):
        pooled_bands.growth(1.5)


def test_one_fit_serves_bands_and_pools(spark):
    df = weekly(spark, {("g", "s", "long"): 30, ("g", "s", "short"): 6, ("b", "s", "one"): 1})
    result = pooled_bands.pooled_bands(df, KEYS)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # the fit is stored, not planned once for each pool
    own = models.fit_spend_response(df, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in own  # moments and ratios of a series come from one aggregate
    rows = models.spend_response_moments(df, KEYS).where("ratio IS NOT NULL").collect()
    for x in models.series_fits(df, KEYS).collect():
        of = [r for r in rows if all(r[k] == x[k] for k in KEYS)]
        assert x.ratios == sorted(r.ratio for r in of)
        assert all((r.slope, r.intercept, r.sigma, r.n_weeks) == (x.slope, x.intercept, x.sigma, x.n_weeks) for r in of)


def test_missing_amounts_add_nothing_to_a_fit(spark):
    rows = [("Google", "a", i, s, r) for i, (s, r) in enumerate([(5.0, 9.0), (5.0, None), (None, 4.0), (5.000001, 11.0), (0.0, None)])]
    rows += [("Google", "b", i, None, None) for i in range(3)] + [("Bing", None, 0, 2.0, 6.0)]
    df = spark.createDataFrame(rows, "channel string, campaign_id string, week int, spend double, revenue double")
    keys = ["channel", "campaign_id"]
    was = {(x.channel, x.campaign_id): x for x in models.spend_response_moments(df, keys).collect()}
    now = models.fit_spend_response(df, keys).collect()
    assert len(now) == len(was) == 3
    for x in now:
        w = was[x.channel, x.campaign_id]
        assert (x.n_weeks, x.slope, x.intercept, x.sigma) == (w.n_weeks, w.slope, w.intercept, w.sigma)
