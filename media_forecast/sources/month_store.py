"""The unified daily table as a store whose months can be delivered again.

``rows/month=…/channel=…`` holds the daily rows, ``checks/month=…/channel=…``
the mergeable quality sums of the same rows (:mod:`operators.stored_checks`).

A delivery replaces the months and channels that it has rows of and no others
(dynamic partition overwrite); it must therefore hold such a month as a whole.
With ``months`` named, a row of any other month fails the write before
anything is replaced. A month of which the delivery has no row stays.

Rows are dealt by ``rebalance``: a month or channel that holds a third of all
rows is split among tasks by size, small ones are merged, so no group lands in
one task and no task writes a file per month of the calendar. What was written
is counted by an ``Observation`` in the writing tasks themselves. The checks
are then computed from the delivered partitions only, and the two counts must
agree. If a run dies between the two writes, delivering again mends it; the
two replaced folders are not one transaction.

Look-back reads take the latest date from the checks and list the folders of
the months in question only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import stored_checks
from ..operators.kpis import DEFAULT_LOOKBACK_DAYS
from .schema import RATIO_COLUMNS, UNIFIED_COLUMNS, UNIFIED_TYPES

PARTITIONS = ["month", "channel"]
ROWS, CHECKS = "rows", "checks"


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _columns(df: DataFrame) -> list[str]:
    return UNIFIED_COLUMNS + [c for c in RATIO_COLUMNS if c in df.columns]


def _replace(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path))


def deliver(df: DataFrame, root: str, months: list[str] | None = None) -> dict:
    """Replace the months and channels of ``df`` in the store; returns the rows written and the partitions replaced.

    ``months`` (``yyyy-MM`` or ``undated``) are those that the delivery may
    hold. An empty delivery changes nothing. Two writing jobs run here.
    """
    spark = df.sparkSession
    month = stored_checks.month_of()
    if months is not None:
        fault = F.raise_error(F.concat(F.lit("row of a month that is not delivered: "), month))
        month = F.when(month.isin(months), month).otherwise(fault.cast("string"))
    seen, measured = Observation(), Observation()
    rows = (
        df.select(*_columns(df)).withColumn("month", month)
        .hint("rebalance", *PARTITIONS)
        # Above the shuffle: tasks of the writing stage count once, however often the stages before were run again.
        .observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set(F.struct(*PARTITIONS)).alias("partitions"))
    )
    _replace(rows, _folder(root, ROWS))
    # Bounded by the calendar's months and the channels.
    replaced: dict[str | None, set[str]] = {}
    for p in seen.get["partitions"]:
        replaced.setdefault(p["channel"], set()).add(p["month"])
    delivered = F.lit(False)
    for channel, of_channel in replaced.items():
        delivered = delivered | (F.col("channel").eqNullSafe(F.lit(channel)) & F.col("month").isin(sorted(of_channel)))
    fresh = _rows(spark, root, sorted(set().union(*replaced.values()))).where(delivered)
    # The sums leave their aggregate spread over all tasks; without the rebalance each task would write a file for every month.
    checks = stored_checks.measure(fresh.drop("month")).hint("rebalance", *PARTITIONS).observe(
        measured, F.coalesce(F.sum("total_records"), F.lit(0)).alias("rows"))
    _replace(checks, _folder(root, CHECKS))
    if measured.get["rows"] != seen.get["rows"]:
        raise RuntimeError(f"{seen.get['rows']} rows written, {measured.get['rows']} in the store: deliver again")
    return {"rows": seen.get["rows"],
            "partitions": sorted(((m, c) for c, of in replaced.items() for m in of), key=lambda p: (p[0], p[1] or ""))}


def _rows(spark: SparkSession, root: str, months: list[str] | None = None) -> DataFrame:
    path = _folder(root, ROWS)
    fields = [T.StructField(c, UNIFIED_TYPES[c]) for c in UNIFIED_COLUMNS + RATIO_COLUMNS]
    schema = T.StructType([*fields, T.StructField("month", T.StringType())])
    if months is not None and not months:
        return spark.createDataFrame([], schema)
    paths = [path] if months is None else [f"{path}/month={m}" for m in months]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths)


def rows_of(spark: SparkSession, root: str, months: list[str] | None = None) -> DataFrame:
    """Daily rows of the store; of ``months``, which it must hold, only the folders are listed and read."""
    return _rows(spark, root, months).select(*UNIFIED_COLUMNS, *RATIO_COLUMNS)


def checks_of(spark: SparkSession, root: str) -> DataFrame:
    """The quality sums of the whole store, input of the reports of :mod:`operators.stored_checks`."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, UNIFIED_TYPES[c]) for c in UNIFIED_COLUMNS + RATIO_COLUMNS]))
    return spark.read.schema(stored_checks.measure(empty).schema).parquet(_folder(root, CHECKS))


def lookback_of(spark: SparkSession, root: str, days: int = DEFAULT_LOOKBACK_DAYS,
                as_of: dt.date | None = None) -> tuple[DataFrame, dt.date | None]:
    """The rows of the look-back window and its last date (``as_of``, else the latest date of the store).

    The date and the months come from the checks, so the window's bound is a
    constant that reaches the scan, and older months are neither listed nor
    read. Without any date in the store the frame is empty and the date None.
    """
    per_month = (checks_of(spark, root).where(F.col("month") != stored_checks.UNDATED)
                 .groupBy("month").agg(F.max("max_date").alias("latest")).collect())  # one row per month of the calendar
    as_of = as_of or max((r["latest"] for r in per_month), default=None)
    if as_of is None:
        return rows_of(spark, root, []), None
    first = as_of - dt.timedelta(days=days)
    months = sorted(r["month"] for r in per_month if r["latest"] >= first)
    return rows_of(spark, root, months).where(F.col("date") >= F.lit(first)), as_of
