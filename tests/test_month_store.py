"""Month store: restated months, clashing and missing values, pruned look-back, checks equal to the daily rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from media_forecast.operators import kpis, quality, stored_checks, unify
from media_forecast.sources import month_store
from media_forecast.sources.schema import UNIFIED_COLUMNS, UNIFIED_SCHEMA, UNIFIED_TYPES


def frame(spark, rows):
    """Rows of (date, channel, name, spend, revenue)."""
    made = [(d, ch, "7", name, "SEARCH", spend, revenue, 3, 100, 1.0, None, None, "r") for d, ch, name, spend, revenue in rows]
    schema = StructType([f for f in UNIFIED_SCHEMA.fields if f.name in UNIFIED_COLUMNS])
    return unify.with_ratios(spark.createDataFrame(made, schema))


D = dt.date
ROWS = [
    (D(2024, 1, 1), "Google", "a", 10.0, 0.0), (D(2024, 1, 31), "Google", "a", 1.0, 99.0),
    (D(2024, 1, 31), "Google", "b", 0.0, 5.0), (D(2024, 2, 3), "Google", "a", 2.0, 0.0),
    (D(2024, 2, 3), "Google", None, 2.0, 0.0), (D(2024, 2, 29), "Bing", "c", -1.0, 4.0),
    (D(2024, 1, 5), "Bing", "c", 7.0, None), (None, "Bing", "c", 3.0, 1.0), (D(2024, 2, 7), None, "d", 3.0, 1.0),
    (D(2024, 5, 1), "Meta", "e", 3.0, 1.0), (D(2024, 5, 1), "Meta", "e", 3.0, 1.0),
]


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    rows = [sorted(map(repr, x.select(*cols).collect())) for x in (a, b)]
    assert rows[0] == rows[1]


def reports(spark, root, df):
    checks = month_store.checks_of(spark, root)
    same(month_store.rows_of(spark, root).select(*df.columns), df)
    same(stored_checks.counts(checks), quality.counts(df))
    same(stored_checks.record_counts(checks), quality.record_counts(df))
    same(stored_checks.missing_values(checks), quality.missing_values(df))
    cover = stored_checks.coverage(checks)
    same(cover.select("channel", "min_date", "max_date"), quality.date_range(df))
    same(cover.select("channel", "missing_dates"), quality.missing_date_counts(df))
    same(cover.drop("min_date", "max_date", "missing_dates"), quality.coverage_mismatch(df))


def test_deliveries_and_restated_month(spark, tmp_path):
    root, df = str(tmp_path / "s"), frame(spark, ROWS)
    got = month_store.deliver(df, root)
    assert got["rows"] == len(ROWS)
    assert ("undated", "Bing") in got["partitions"] and ("2024-02", None) in got["partitions"]
    reports(spark, root, df)
    # Google's January comes again: one row gone, one changed. Nothing else moves.
    again = [(D(2024, 1, 2), "Google", "z", 5.0, 6.0)]
    got = month_store.deliver(frame(spark, again), root, ["2024-01"])
    assert got == {"rows": 1, "partitions": [("2024-01", "Google")]}
    rest = [r for r in ROWS if not (r[1] == "Google" and r[0] and r[0].month == 1)]
    reports(spark, root, frame(spark, rest + again))
    # The same delivery twice changes nothing.
    month_store.deliver(frame(spark, again), root, ["2024-01"])
    reports(spark, root, frame(spark, rest + again))


def test_row_of_other_month_replaces_nothing(spark, tmp_path):
    root, df = str(tmp_path / "s"), frame(spark, ROWS)
    month_store.deliver(df, root)
    with pytest.raises(Exception, match="not delivered: 2024-02"):
        month_store.deliver(frame(spark, [(D(2024, 1, 1), "Google", "a", 1.0, 1.0), (D(2024, 2, 1), "Google", "a", 1.0, 1.0)]),
                            root, ["2024-01"])
    reports(spark, root, df)


def test_empty_delivery_and_extra_columns(spark, tmp_path):
    root, df = str(tmp_path / "s"), frame(spark, ROWS)
    empty = df.limit(0)
    assert month_store.deliver(empty, root) == {"rows": 0, "partitions": []}
    reports(spark, root, empty)
    assert month_store.lookback_of(spark, root)[1] is None
    month_store.deliver(df.withColumn("month", F.lit("x")).withColumn("days", F.lit(1)), root)
    assert month_store.deliver(empty, root)["rows"] == 0
    reports(spark, root, df)


def test_lookback_reads_its_months_only(spark, tmp_path):
    root, df = str(tmp_path / "s"), frame(spark, ROWS)
    month_store.deliver(df, root)
    for days, as_of, months in [(90, None, {"2024-02", "2024-05"}), (0, None, {"2024-05"}),
                                (5, D(2024, 3, 1), {"2024-02", "2024-05"}), (9999, None, {"2024-01", "2024-02", "2024-05"})]:
        recent, latest = month_store.lookback_of(spark, root, days, as_of)
        assert latest == (as_of or D(2024, 5, 1))
        same(recent.select(*df.columns), kpis.lookback(df, days, as_of))
        assert {p.split("month=")[1].split("/")[0] for p in recent.inputFiles()} == months
        plan = kpis.channel_metrics(recent, days, latest)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
        same(kpis.channel_metrics(recent, days, latest), kpis.channel_metrics(df, days, as_of))


def test_hot_month_is_split(spark, tmp_path):
    """A month of a third of all rows goes to several tasks; its rows stay whole."""
    n = 60_000
    big = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-15")).otherwise(F.date_add(F.lit("2023-01-01"), (F.col("id") % 300).cast("int")))
        .cast("date").alias("date"),
        *[F.lit("Google" if c == "channel" else None).cast(UNIFIED_TYPES[c]).alias(c) if c not in ("campaign_id", "campaign_name")
          else F.sha2(F.concat(F.lit(c), "id"), 256).alias(c) for c in UNIFIED_COLUMNS if c != "date"])
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        root = str(tmp_path / "s")
        assert month_store.deliver(big, root)["rows"] == n
    finally:
        spark.conf.set(key, old)
    hot = month_store.rows_of(spark, root, ["2024-01"])
    assert hot.count() == n // 3 and len(hot.inputFiles()) > 1
    assert month_store.rows_of(spark, root).count() == n


def test_sums_are_written_as_one_file_a_month(spark, tmp_path):
    """Without it each task of the aggregate writes a file for each of its months and channels."""
    rows = [(D(2023, m, 1 + k), ch, f"{ch}{k}", 1.0, 2.0) for m in range(1, 13) for k in range(20) for ch in ("Google", "Meta")]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # as with more data than fits one task
    try:
        made = month_store.deliver(frame(spark, rows), str(tmp_path / "s"))
    finally:
        spark.conf.set(key, "true")
    assert made["rows"] == len(rows) and len(made["partitions"]) == 24
    files = list((tmp_path / "s" / "checks").rglob("*.parquet"))
    assert len(files) == 24 and len({f.parent for f in files}) == 24
    assert month_store.checks_of(spark, str(tmp_path / "s")).count() == len(rows)
