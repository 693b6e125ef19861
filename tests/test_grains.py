"""Several grains from one pass: equal to each grain by itself, missing keys marked and counted, one scan."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from media_forecast.operators import grains, kpis

SCHEMA = ("date date, channel string, campaign_type string, campaign_id string, campaign_name string, "
          "spend double, revenue double, clicks long, impressions long, conversions double")
MON = dt.date(2024, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def daily(spark):
    rows = []
    for k in range(400):
        rows.append((MON + dt.timedelta(days=k % 23), ["a", "b", None][k % 7 % 3], ["s", None][k % 5 == 0],
                     f"c{k % 4}", None if k % 11 == 0 else f"n{k % 4}", 0.1 * k if k % 13 else None, 0.3 * k,
                     k if k % 3 else None, None, 0.123457 * k))
    return rows_of(spark, rows)


def data(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_grain_is_the_roll_up_by_itself(daily):
    rolled = grains.weekly_grains(daily).cache()
    for grain in kpis.GRAINS:
        assert data(grains.of_grain(rolled, grain)) == data(kpis.weekly(daily, grain))
    total = grains.of_grain(rolled, "total")
    assert data(total) == data(kpis.weekly(daily.withColumn("all", F.lit(1)), ["all"]).drop("all"))
    rolled.unpersist()


def test_missing_keys_are_marked_and_counted(daily):
    got = {r.grain: r for r in grains.left_out(grains.weekly_grains(daily)).collect()}
    assert set(got) == {*kpis.GRAINS, "total"}
    assert all(r.rows == 400 for r in got.values()) and len({r.spend for r in got.values()}) == 1
    for grain, keys in kpis.GRAINS.items():
        gone = daily.filter(~kpis.keys_present(keys))
        assert got[grain].rows_without_key == gone.count() > 0
        want = gone.agg(F.sum(F.col("revenue").cast("decimal(28,6)")).cast("double")).first()[0]
        assert got[grain].revenue_without_key == want
    assert got["total"].rows_without_key == 0


def test_rows_are_read_and_shuffled_once(spark, daily, tmp_path):
    daily.write.parquet(str(tmp_path / "d"))
    plan = grains.weekly_grains(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    # Rows are combined before they are multiplied by the grains.
    assert plan.index("Expand") < plan.index("FileScan") and plan[plan.index("Expand"):].count("HashAggregate") >= 2


def test_undated_empty_and_other_grains(spark, daily):
    undated = rows_of(spark, [(None, "a", "s", "c", "n", 1.0, 2.0, 1, 1, 1.0), (MON, "a", "s", "c", "n", 1.0, 2.0, 1, 1, 1.0)])
    with pytest.raises(Exception, match="row without a date"):
        grains.weekly_grains(undated).collect()
    seen = Observation("undated")
    assert len(grains.weekly_grains(undated, undated=seen).collect()) == 4 and seen.get["rows"] == 1
    assert grains.weekly_grains(daily.limit(0)).collect() == []
    one = grains.weekly_grains(daily, {"kind": ["campaign_type"]})
    assert {r.grain for r in one.collect()} == {"kind", "total"}
    for bad in ({"x": ["channel"], "y": ["channel"]}, {"x": []}, {"total": ["channel"]}):
        with pytest.raises(ValueError):
            grains.weekly_grains(daily, bad)


def test_blended_row_runs_the_forecast_once(spark):
    fc = spark.createDataFrame(
        [(1, "a", 10.0, 1.5, 2.0, 3.0), (1, None, 0.0, 0.25, 0.5, 1.0), (2, "a", 0.0, 0.0, 0.0, 0.0)],
        "scenario_id int, channel string, planned_spend double, revenue_low double, revenue_median double, revenue_high double")
    got = {(r.scenario_id, r.channel, r.blended): r for r in grains.with_blended(fc).collect()}
    assert set(got) == {(1, "a", False), (1, None, False), (1, None, True), (2, "a", False), (2, None, True)}
    r = got[1, None, True]
    assert (r.total_spend, r.revenue_low, r.revenue_high, r.roas_median) == (10.0, 1.75, 4.0, 0.25)
    assert got[2, None, True].roas_low == 0.0
    table = {(x.scenario_id, x.channel): x.band for x in grains.range_table(grains.with_blended(fc)).collect()}
    assert table[1, "blended"] == 2.25
