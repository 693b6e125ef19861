"""Digits, coercion and storage rules that the fixtures alone do not show."""

import pytest
from pyspark.sql import functions as F

from media_forecast import session
from media_forecast.functions import exact_sum, safe_ratio
from media_forecast.operators import allocation, scenarios


def test_sums_keep_micros(spark):
    small = spark.range(1000).select(F.lit(0.00004).alias("x"), F.lit(0.123456).alias("y"))
    assert tuple(small.agg(exact_sum("x"), exact_sum("y")).first()) == (0.04, 123.456)
    large = spark.createDataFrame([(1e15,), (2.5,)], "x double")
    assert large.agg(exact_sum("x")).first()[0] == 1e15 + 2.5


def test_safe_ratio_of_odd_values(spark):
    rows = [("6", "3", 2.0), ("NaN", "3", 0.0), ("6", "NaN", 0.0), ("six", "3", 0.0), (None, "3", 0.0), ("6", "0", 0.0), ("6", None, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert df.where(safe_ratio("a", "b") != F.col("want")).count() == 0
    assert spark.createDataFrame([(float("nan"), 2.0)], "a double, b double").select(safe_ratio("a", "b")).first()[0] == 0.0


def test_budget_share_adds_up(spark):
    df = spark.createDataFrame([(1, "a", 30.0), (1, "b", 10.0), (2, "a", 0.0)], "scenario_id int, channel string, planned_spend double")
    got = {(r.scenario_id, r.channel): r.share for r in scenarios.budget_share(df).collect()}
    assert got == {(1, "a"): 0.75, (1, "b"): 0.25, (2, "a"): 0.0}


def test_ranked_takes_both_shapes(spark):
    one = spark.createDataFrame([("c", "n", "t", 1.0)], "channel string, campaign_name string, campaign_type string, forecast_revenue double")
    assert allocation.ranked(one).count() == 1
    assert allocation.ranked(one.withColumn("scenario_id", F.lit(1))).count() == 1


def test_cluster_without_shared_folder_raises():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
