"""Sink for the harmonised daily table: Parquet partitioned by channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import RATIO_COLUMNS, UNIFIED_COLUMNS, UNIFIED_TYPES
from .vendors import RAW, REASONS

PLACE = "__place"


def write_unified(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write unified rows as Parquet partitioned by channel.

    Rows are clustered by channel within each task (no global sort, no extra
    shuffle), so each task writes one file per channel it holds.
    """
    (
        df.select(*UNIFIED_COLUMNS, *[c for c in RATIO_COLUMNS if c in df.columns])
        .sortWithinPartitions("channel", "date")
        .write.mode(mode)
        .partitionBy("channel")
        .parquet(path)
    )


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    """Read back a unified table; a channel filter prunes partitions."""
    df = spark.read.parquet(path)
    cols = [c for c in UNIFIED_COLUMNS + RATIO_COLUMNS if c in df.columns]
    return df.select(*cols)


def write_sorted(df: DataFrame, path: str, keys: list[str], files: int | None = None, mode: str = "overwrite") -> None:
    """Publish rows in order of ``keys`` (nulls first): every file holds one range of them, in order.

    Bounds are sampled over all keys, so a date of a third of all rows is
    split among files by the keys behind it (rows equal in every key stay
    together); no task sorts more than its range. ``file_no`` and ``row_no``
    (from 0) keep the place of a row. A filter on the first key skips files and
    row groups by their statistics. Columns may not be named like the places.
    """
    if clash := {PLACE, "file_no", "row_no", "position"} & set(df.columns):
        raise ValueError(f"columns named like a place of the sorted table: {sorted(clash)}")
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    (
        dealt.sortWithinPartitions(*order)
        .withColumn(PLACE, F.monotonically_increasing_id())  # number of the task, and of the row in it
        .select(*df.columns, F.shiftright(PLACE, 33).cast("int").alias("file_no"),
                F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1)).alias("row_no"))
        .write.mode(mode).parquet(path)
    )


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """Rows of :func:`write_sorted` with ``position`` (from 1) in the whole table; the sizes of the files are all that is summed up."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("file_no").agg(F.count(F.lit(1)).alias("size"))
    # One row per file.
    before = sizes.select("file_no", (F.sum("size").over(Window.orderBy("file_no")) - F.col("size")).alias("before"))
    return (rows.join(before, "file_no").withColumn("position", F.col("before") + F.col("row_no") + 1)
            .drop("file_no", "row_no", "before"))


def write_parsed(parsed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the rows of ``parse_lenient`` in one pass: good rows and rejects land in folders of their own.

    ``rejected=false`` holds the unified rows, ``rejected=true`` the rows with
    reasons and raw fields; each task writes both, nothing is read twice.
    """
    parsed.withColumn("rejected", F.col(REASONS).isNotNull()).write.mode(mode).partitionBy("rejected").parquet(path)


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good unified rows, rejects) written by :func:`write_parsed`; each reads its own folder only."""
    fields = [*[T.StructField(c, UNIFIED_TYPES[c]) for c in UNIFIED_COLUMNS], T.StructField(REASONS, T.ArrayType(T.StringType())),
              T.StructField(RAW, T.StringType()), T.StructField("rejected", T.BooleanType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    return rows.where("NOT rejected").select(*UNIFIED_COLUMNS), rows.where("rejected").select("channel", REASONS, RAW)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a vendor-layout frame as headed CSV files (the exports' own format)."""
    df.write.mode(mode).option("header", True).csv(path)
