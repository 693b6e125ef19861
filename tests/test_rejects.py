"""Lenient parsing: every row of an export is either a unified row or a reject with reasons."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from media_forecast.sources.sinks import read_parsed, write_parsed
from media_forecast.sources.vendors import load_google, load_lenient, parse_lenient, split_rejects

GOOGLE = ["segments_date", "metrics_clicks", "metrics_conversions", "metrics_cost_micros", "metrics_impressions",
          "metrics_conversions_value", "campaign_advertising_channel_type", "campaign_budget_amount", "campaign_id", "campaign_name"]
GOOD = ["2024-01-05", "1", "1.5", "2500000", "10", "7.0", "SEARCH", "5", "c1", "n"]


def row(**changes):
    return [changes.get(c, v) for c, v in zip(GOOGLE, GOOD, strict=True)]


ROWS = [
    (row(), None),
    (row(segments_date="soon"), ["segments_date: not a date"]),
    (row(metrics_clicks="2.5"), ["metrics_clicks: not a whole number"]),
    (row(metrics_clicks="1e400"), ["metrics_clicks: not a whole number"]),
    (row(metrics_clicks="x", metrics_conversions_value="x"), ["metrics_conversions_value: not a number", "metrics_clicks: not a number"]),
    (row(segments_date="NA", metrics_clicks="", campaign_budget_amount="null", metrics_cost_micros="NaN"), None),
    (row(metrics_clicks="3.0", segments_date="1/5/2024"), None),
    ([None] * 10, None),
]


def frame(spark):
    return spark.createDataFrame([r for r, _ in ROWS], ",".join(f"{c} string" for c in GOOGLE))


def test_every_row_is_good_or_has_reasons(spark, tmp_path):
    seen = Observation("seen")
    parsed = parse_lenient(frame(spark), "Google", seen)
    got = parsed.select("reject_reasons").collect()
    assert [r.reject_reasons and sorted(r.reject_reasons) for r in got] == [w and sorted(w) for _, w in ROWS]
    assert seen.get == {"rows": len(ROWS), "rejected": 4}
    good, bad = split_rejects(parse_lenient(frame(spark), "Google"))
    assert good.count() == 4 and "raw_row" not in good.columns
    raws = [json.loads(r.raw_row) for r in bad.collect()]
    assert {tuple(x[c] for c in GOOGLE) for x in raws} == {tuple(r) for r, w in ROWS if w}
    # Both outputs come from one write, and each is read by itself.
    path = str(tmp_path / "parsed")
    write_parsed(parse_lenient(frame(spark), "Google"), path)
    stored_good, stored_bad = read_parsed(spark, path)
    assert sorted(map(str, stored_good.collect())) == sorted(map(str, good.collect()))
    assert sorted(map(str, stored_bad.collect())) == sorted(map(str, bad.collect()))
    plan = stored_good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rejected" in plan


def test_strict_mode_still_fails(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    (d / "a.csv").write_text("\n".join([",".join(GOOGLE), ",".join(row()), ",".join(row(segments_date="soon"))]) + "\n")
    with pytest.raises(PySparkException, match="not a date"):
        load_google(spark, str(d)).collect()
    good, bad = split_rejects(load_lenient(spark, "Google", str(d)))
    assert (good.count(), bad.count()) == (1, 1)


def test_typed_and_empty_exports(spark, tmp_path):
    typed = spark.createDataFrame([(1, 2.5)], "a int, b double").select(
        F.current_date().alias("date_start"), F.lit(None).cast("double").alias("conversion"), F.lit("1").alias("campaign_id"),
        F.lit("n").alias("campaign_name"), F.col("b").alias("spend"), F.lit(3).alias("clicks"), F.lit(4.5).alias("impressions"),
        F.lit(None).cast("double").alias("daily_budget"))
    got = parse_lenient(typed, "Meta").collect()
    assert [r.reject_reasons for r in got] == [["impressions: not a whole number"]]
    none = parse_lenient(frame(spark).limit(0), "Google")
    path = str(tmp_path / "none")
    write_parsed(none, path)
    assert [x.count() for x in read_parsed(spark, path)] == [0, 0]
