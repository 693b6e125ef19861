"""The data source of vendor exports: headers read by the tasks, ranges, streams."""

import gzip
import time

import pytest

from media_forecast.sources import export_source as X
from media_forecast.sources.vendors import load_bing, load_google, load_meta
from media_forecast.plans.catalog import _scratch
from media_forecast.sources import fixtures
from media_forecast.sources.sinks import export_csv

GOOGLE = ("segments_date,metrics_clicks,metrics_conversions,metrics_cost_micros,metrics_impressions,"
          "metrics_conversions_value,campaign_advertising_channel_type,campaign_budget_amount,campaign_id,campaign_name")
SWAPPED = ",".join(reversed(GOOGLE.split(",")))


def line(k, order=GOOGLE):
    values = dict(zip(GOOGLE.split(","), ["2024-01-05", str(k), "1", "2500000", "10", "7.5", "SEARCH", "NA", f"c{k}", f'"Näme, {k}"'], strict=True))
    return ",".join(values.get(c, "extra") for c in order.split(","))


def put(folder, name, header, rows, lead="", end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(lead + header + end + end.join(rows) + end, encoding="utf-8", newline="")


def rows(df):
    return sorted(map(str, df.collect()))


def test_every_file_by_its_own_header(spark, tmp_path):
    d = tmp_path / "g"
    put(d, "a.csv", GOOGLE, [line(k) for k in range(50)])
    put(d, "b.csv", SWAPPED, [line(k, SWAPPED) for k in range(50, 80)], lead="\ufeff\n  \n", end="\r\n")
    put(d, "c.csv", "more," + GOOGLE, [line(k, "more," + GOOGLE) for k in range(80, 90)])
    put(d, "_hidden.csv", "x", ["1"])
    (d / "empty.csv").write_text("")
    (d / "header only.csv").write_text(GOOGLE)
    with gzip.open(d / "d.csv.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join([GOOGLE, *[line(k) for k in range(90, 99)]]))
    want = rows(load_google(spark, str(d)))
    assert len(want) == 99
    assert rows(X.load_vendor_export(spark, "Google", str(d))) == want
    assert rows(X.load_vendor_export(spark, "Google", f"file:{d}")) == want
    X.register(spark)
    for size in (1, 7, 100, 333):  # every row is in exactly one range, wherever ranges end
        raw = spark.read.format(X.FORMAT).option("channel", "Google").option("rangeBytes", size).load(str(d / "a.csv"))
        assert sorted(r.campaign_id for r in raw.collect()) == sorted(f"c{k}" for k in range(50))
    assert X.load_vendor_export(spark, "Google", str(d / "[ab].csv")).count() == 80
    assert X.load_vendor_export(spark, "Google", str(tmp_path / "none")).count() == 0


def test_the_driver_opens_no_file(tmp_path, monkeypatch):
    d = tmp_path / "g"
    put(d, "a.csv", GOOGLE, [line(1)])
    monkeypatch.setattr(X, "header_of", lambda lines: pytest.fail("opened"))
    parts = X.ExportReader({"channel": "Google", "path": str(d), "rangebytes": "100"}).partitions()
    assert [(p.start, p.end) for p in parts][:2] == [(0, 100), (100, 200)]


def test_lacking_fields_fail(spark, tmp_path):
    put(tmp_path / "g", "a.csv", "segments_date,campaign_id", ["2024-01-01,1"])
    with pytest.raises(Exception, match="lacks fields"):
        X.load_vendor_export(spark, "Google", str(tmp_path / "g")).collect()
    with pytest.raises(Exception, match="unknown channel"):
        X.ExportReader({"channel": "Other", "path": "x"})


def test_meta_revenue_by_file(spark, tmp_path):
    d = tmp_path / "m"
    base = "date_start,conversion,campaign_id,campaign_name,spend,clicks,impressions,daily_budget"
    put(d, "a.csv", base, ["2024-01-01,2,1,generic,10,1,1,5"])
    put(d, "b.csv", base + ",revenue", ["2024-01-02,2,1,dpa,10,1,1,5,33"])
    put(d, "c.csv", "conversion_value," + base, ["4,2024-01-03,2,1,n,10,1,1,5"])
    assert rows(X.load_vendor_export(spark, "Meta", str(d))) == rows(load_meta(spark, str(d)))
    got = X.load_vendor_export(spark, "Meta", str(d), estimated_aov=12.5)
    assert rows(got) == rows(load_meta(spark, str(d), estimated_aov=12.5))


def test_spark_exports_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    for channel, raw, load in (("Bing", fixtures.bing_raw, load_bing), ("Meta", fixtures.meta_raw, load_meta)):
        path = _scratch(spark, f"source-{channel}")
        export_csv(raw(spark, sf), path)
        assert rows(X.load_vendor_export(spark, channel, path)) == rows(load(spark, path))


def test_stream_takes_mixed_headers(spark, tmp_path):
    d, out, state = tmp_path / "g", str(tmp_path / "out"), str(tmp_path / "state")
    put(d, "b.csv", GOOGLE, [line(k) for k in range(5)])

    def run():
        q = (X.stream_vendor_export(spark, "Google", str(d)).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(r.campaign_id for r in spark.read.parquet(out).collect())

    assert run() == [f"c{k}" for k in range(5)]
    time.sleep(0.05)
    put(d, "a.csv", SWAPPED, [line(k, SWAPPED) for k in range(5, 8)])  # a restart takes the new file alone
    assert run() == [f"c{k}" for k in range(8)]
    assert run() == [f"c{k}" for k in range(8)]
