"""CSV exports whose files differ: headers, date texts, fractional counts."""

import pytest
from pyspark.errors import StreamingQueryException

from media_forecast.sources.vendors import load_channels, load_google, load_meta, read_export_csv
from media_forecast.streaming.ingest import export_stream

GOOGLE = ("segments_date,metrics_clicks,metrics_conversions,metrics_cost_micros,metrics_impressions,"
          "metrics_conversions_value,campaign_advertising_channel_type,campaign_budget_amount,campaign_id,campaign_name")
SWAPPED = GOOGLE.replace("metrics_cost_micros", "#").replace("metrics_conversions_value", "metrics_cost_micros").replace(
    "#", "metrics_conversions_value")


def _file(folder, name, header, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


def test_files_are_read_by_their_own_header(spark, tmp_path):
    d = tmp_path / "google data"
    _file(d, "a.csv", GOOGLE, "2024-01-01,1,1,1000000,10,7.0,SEARCH,5,c1,n")
    _file(d, "b.csv", "extra," + SWAPPED, "x,2024-01-02,1,1,7.0,10,1000000,SEARCH,5,c2,n")
    (d / "empty.csv").write_text("")
    rows = load_channels(spark, {"Google": str(d)})["Google"].orderBy("date").collect()
    assert [(r.campaign_id, r.spend, r.revenue) for r in rows] == [("c1", 1.0, 7.0), ("c2", 1.0, 7.0)]


def test_stream_refuses_mixed_headers(spark, tmp_path):
    d = tmp_path / "g"
    _file(d, "a.csv", GOOGLE, "2024-01-01,1,1,1000000,10,7.0,SEARCH,5,c1,n")
    _file(d, "b.csv", SWAPPED, "2024-01-02,1,1,7.0,10,1000000,SEARCH,5,c2,n")
    with pytest.raises(ValueError, match="different headers"):
        export_stream(spark, "Google", str(d))


def test_stream_fails_on_a_later_file_in_another_order(spark, tmp_path):
    d = tmp_path / "g"
    _file(d, "a.csv", SWAPPED, "2024-01-02,1,1,7.0,10,1000000,SEARCH,5,c2,n")
    stream = export_stream(spark, "Google", str(d), fields=GOOGLE.split(","))
    query = (stream.writeStream.format("memory").queryName("swapped").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()


def test_meta_revenue_follows_each_files_fields(spark, tmp_path):
    d = tmp_path / "m"
    base = "date_start,conversion,campaign_id,campaign_name,spend,clicks,impressions,daily_budget"
    _file(d, "a.csv", base, "2024-01-01,2,1,n,10,1,1,5")
    _file(d, "b.csv", base + ",revenue", "2024-01-02,2,1,n,10,1,1,5,33")
    rows = load_meta(spark, str(d)).orderBy("date").collect()
    assert [(r.revenue, r.revenue_is_estimated) for r in rows] == [(20.0, True), (33.0, False)]


def test_usual_date_texts(spark, tmp_path):
    texts = ["2024-01-05", "1/5/2024", "01/05/2024 0:00", "2024/1/5", "20240105", "5-Jan-2024", '"Jan 5, 2024"', " 2024-01-05 00:00:00"]
    _file(tmp_path / "g", "a.csv", GOOGLE, *[f"{t},1,1,1,1,1,S,5,c,n" for t in texts], "NA,1,1,1,1,1,S,5,c,n")
    dates = [r.date for r in load_google(spark, str(tmp_path / "g")).select("date").collect()]
    assert [str(d) for d in dates] == ["2024-01-05"] * len(texts) + ["None"]


@pytest.mark.parametrize("line,what", [("someday,1,1,1,1,1,S,5,c,n", "not a date"), ("2024-01-05,3.7,1,1,1,1,S,5,c,n", "not a whole number")])
def test_unreadable_values_fail(spark, tmp_path, line, what):
    _file(tmp_path / "g", "a.csv", GOOGLE, line)
    with pytest.raises(Exception, match=what):
        load_google(spark, str(tmp_path / "g")).collect()


@pytest.mark.parametrize("second", [GOOGLE, SWAPPED])
def test_files_with_leading_blank_lines_keep_their_rows(spark, tmp_path, second):
    d = tmp_path / "g"
    _file(d, "a [1].csv", "\n \t\n" + GOOGLE, "2024-01-01,1,1,7,10,7,SEARCH,5,c1,n")
    _file(d, "b{x}.csv", second, "2024-01-02,1,1,7,10,7,SEARCH,5,c2,n")
    _file(d, "c.csv", "\ufeff\n" + GOOGLE, "2024-01-03,1,1,7,10,7,SEARCH,5,c3,n")
    (d / "blank.csv").write_text("\n \n")
    rows = load_google(spark, str(d)).orderBy("date").collect()
    assert [(r.campaign_id, r.revenue) for r in rows] == [("c1", 7.0), ("c2", 7.0), ("c3", 7.0)]


@pytest.mark.parametrize("second", [GOOGLE, SWAPPED])
def test_partition_folders_do_not_depend_on_headers(spark, tmp_path, second):
    for k, header in enumerate((GOOGLE, second)):
        (tmp_path / "g").mkdir(exist_ok=True)
        _file(tmp_path / "g" / f"part={k}", "a.csv", header, "2024-01-02,1,1,7,10,7,SEARCH,5,c2,n")
    for path in (str(tmp_path / "g"), str(tmp_path / "g" / "part=*"), [str(tmp_path / "g" / f"part={k}" / "a.csv") for k in (0, 1)]):
        frame = read_export_csv(spark, path)
        assert frame.count() == 2
        if isinstance(path, str):
            assert sorted(str(r.part) for r in frame.collect()) == ["0", "1"]
