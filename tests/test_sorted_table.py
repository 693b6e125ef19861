"""Published order: positions equal a sort of all rows, files hold disjoint ranges, hot dates are split."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from media_forecast.sources.sinks import read_sorted, write_sorted


def rows(spark, n=5000):
    """A third of the rows on one date, some without a date, some repeated."""
    d = F.when(F.col("id") % 3 == 0, F.lit("2024-01-15")).when(F.col("id") % 97 != 1, F.date_add(F.lit("2023-01-01"), (F.col("id") % 400).cast("int")))
    made = spark.range(n).select(d.cast("date").alias("date"), F.sha2(F.col("id").cast("string"), 256).alias("campaign_id"),
                                 (F.col("id") % 7).alias("place"))
    return made.unionAll(made.where("id % 50 = 0"))


def test_positions_and_ranges(spark, tmp_path):
    df, path = rows(spark), str(tmp_path / "t")
    write_sorted(df, path, ["date", "campaign_id"], files=6)
    key = lambda r: (r["date"] is not None, r["date"] or dt.date.min, r["campaign_id"])
    want = sorted(df.collect(), key=key)
    got = sorted(read_sorted(spark, path).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1, len(want) + 1))
    assert [(r["date"], r["campaign_id"], r["place"]) for r in got] == [(r["date"], r["campaign_id"], r["place"]) for r in want]
    held = spark.read.parquet(path).groupBy("file_no").agg(
        F.min(F.struct("date", "campaign_id")).alias("lo"), F.max(F.struct("date", "campaign_id")).alias("hi"), F.count("*").alias("n"),
        F.count_if(F.col("date") == F.lit("2024-01-15")).alias("hot")).orderBy("file_no").collect()
    assert len(held) == 6 and max(r["n"] for r in held) < len(want) / 3 and sum(r["hot"] > 0 for r in held) > 1
    assert all(key(a["hi"]) <= key(b["lo"]) for a, b in zip(held, held[1:]))


def test_empty(spark, tmp_path):
    df, path = rows(spark, 10).limit(0), str(tmp_path / "t")
    write_sorted(df, path, ["date", "campaign_id"])
    assert read_sorted(spark, path).collect() == []


def test_clashing_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="row_no"):
        write_sorted(spark.range(3).withColumnRenamed("id", "row_no"), str(tmp_path / "t"), ["row_no"])
