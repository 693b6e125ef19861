"""Streaming weekly roll-up equals the batch roll-up for every finalized week."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from media_forecast.operators import backtest, kpis
from media_forecast.sources import fixtures, load_channels
from media_forecast.sources.sinks import export_csv
from media_forecast.streaming import run_weekly
from media_forecast.streaming.ingest import ingest_report

SF = "/root/testdata/sf0.001"


def test_weekly_stream_matches_batch(spark, tmp_path):
    raw = fixtures.google_raw(spark, SF)
    src = str(tmp_path / "google_in")
    export_csv(raw.filter(F.col("segments_date") < F.lit("1998-01-01")), src + "/part1")
    export_csv(raw.filter(F.col("segments_date") >= F.lit("1998-01-01")), src + "/part2")
    out, ckpt = str(tmp_path / "weekly_out"), str(tmp_path / "ckpt")
    q = run_weekly(spark, {"Google": src + "/*"}, out, ckpt, watermark="14 days")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = kpis.weekly(load_channels(spark, {"Google": raw})["Google"], "channel")
    max_date = batch.agg(F.max("week")).first()[0]
    final = batch.filter(F.col("week") < F.lit(max_date - dt.timedelta(days=21)))
    cols = ["channel", "week", "spend", "revenue", "clicks", "impressions", "conversions", "roas"]
    a = sorted(tuple(r) for r in final.select(*cols).collect())
    b = sorted(tuple(r) for r in got.select(*cols).filter(F.col("week") < F.lit(max_date - dt.timedelta(days=21)))
               .collect())
    assert len(a) > 100 and a == b


GOOGLE = ("segments_date,metrics_clicks,metrics_conversions,metrics_cost_micros,metrics_impressions,"
          "metrics_conversions_value,campaign_advertising_channel_type,campaign_budget_amount,campaign_id,campaign_name")
BING = "TimePeriod,CampaignId,CampaignName,CampaignType,Spend,Revenue,Clicks,Impressions,Conversions,DailyBudget"


def test_lagging_channel_keeps_its_weeks_and_losses_are_counted(spark, tmp_path):
    dirs = {c: str(tmp_path / c) for c in ("Google", "Bing")}
    for d in dirs.values():
        (tmp_path / d).mkdir()

    def put(channel, name, header, dates, line):
        (tmp_path / channel / name).write_text("\n".join([header, *[f"{d},{line}" for d in dates]]) + "\n")

    def run():
        q = run_weekly(spark, dirs, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        q.awaitTermination(120)
        return ingest_report(q)

    put("Google", "a.csv", GOOGLE, ["2024-01-01", "2024-06-03"], "1,1,1000000,10,7.0,SEARCH,5,c1,n")
    put("Bing", "a.csv", BING, ["2024-01-01", "NA"], "b1,n,Search,3,4,1,1,1,5")
    first = run()
    assert first["undated"]["Bing"] == {"rows": 1, "spend": 3.0, "revenue": 4.0} and first["undated"]["Google"]["rows"] == 0
    # The watermark moves in runs in which every channel has rows.
    put("Google", "b.csv", GOOGLE, ["2024-06-10"], "1,1,1000000,10,7.0,SEARCH,5,c1,n")
    put("Bing", "b.csv", BING, ["2024-02-05", "2024-05-06"], "b1,n,Search,3,4,1,1,1,5")
    assert run()["late"] == 0
    put("Google", "c.csv", GOOGLE, ["2024-06-11"], "1,1,1000000,10,7.0,SEARCH,5,c1,n")
    put("Bing", "c.csv", BING, ["2024-01-02"], "b1,n,Search,3,4,1,1,1,5")
    assert run()["late"] == 1
    got = {(r.channel, str(r.week)): r.spend for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("Google", "2024-01-01"): 1.0, ("Bing", "2024-01-01"): 3.0, ("Bing", "2024-02-05"): 3.0}


@pytest.mark.parametrize("sums", [kpis.weekly, lambda df, **k: backtest.series_daily(df, ["channel"], **k)])
def test_undated_rows_fail_or_are_counted(spark, sums):
    df = spark.sql("SELECT 'Google' AS channel, d AS date, 100D AS spend, 5D AS revenue, 1L AS clicks, 1L AS impressions, 1D AS conversions "
                   "FROM VALUES (DATE'2024-01-01'), (CAST(NULL AS DATE)) t(d)")
    with pytest.raises(Exception, match="without a date"):
        sums(df).collect()
    undated = Observation()
    assert [r.spend for r in sums(df, undated=undated).collect()] == [100.0]
    assert undated.get == {"rows": 1, "spend": 100.0, "revenue": 5.0}
