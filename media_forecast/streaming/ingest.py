"""Incremental ingest of vendor exports with Structured Streaming.

New export files dropped into a channel's folder are mapped with the same
projection as the batch readers and rolled up into weekly sums per series.
The weekly window is a 7-day tumbling event-time window aligned to Mondays
(epoch day 0 is a Thursday, so the windows start 4 days later); a watermark
bounds state, so a week is final and emitted once no file can still add to it.
Each channel has a watermark of its own and the slowest one counts, so a
channel may lag the others by any time; it moves only in runs in which every
channel has new rows, until then weeks wait.
Rows without a date and rows that come too late are left out and counted
(:func:`ingest_report`).
State and progress live in the checkpoint folder, so a restarted or
relocated job resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..functions import exact
from ..operators.kpis import grain_keys, keys_present, undated_counts
from ..operators.unify import with_ratios
from ..sources.schema import BING_FIELDS, GOOGLE_FIELDS, META_FIELDS
from ..sources.vendors import MAPPERS, conform, export_headers, text_schema

EXPORT_FIELDS = {"Google": list(GOOGLE_FIELDS), "Bing": list(BING_FIELDS), "Meta": list(META_FIELDS)}
WEEK = "7 days"
MONDAY_OFFSET = "4 days"


def export_stream(spark: SparkSession, channel: str, directory: str, fields: list[str] | None = None,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming unified rows from CSV exports arriving in ``directory`` (all text).

    A file stream reads columns by position, so the header order is taken from
    ``fields`` or, when omitted, from the files already present (a header-only
    read); the mapping then selects the vendor fields by name. Files present
    with different headers are refused, and a later file whose used columns
    stand elsewhere fails the query instead of being read by position.
    """
    if fields is None:
        headers = list(export_headers(spark, directory))
        if len(headers) > 1:
            raise ValueError(f"{channel} export has {len(headers)} different headers; give each its own folder")
        fields = list(headers[0])
    missing = set(EXPORT_FIELDS[channel]) - set(fields)
    if missing:
        raise ValueError(f"{channel} export lacks fields {sorted(missing)}")
    reader = spark.readStream.option("header", True).option("enforceSchema", False).schema(text_schema(fields))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return conform(MAPPERS[channel](reader.csv(directory)))


def _watermarked(stream: DataFrame, watermark: str, name: str) -> DataFrame:
    counted = stream.observe(name, *undated_counts()).filter(F.col("date").isNotNull())
    return counted.withColumn("event_ts", F.col("date").cast("timestamp")).withWatermark("event_ts", watermark)


def unified_stream(spark: SparkSession, directories: Mapping[str, str], watermark: str | None = None) -> DataFrame:
    """Rows of all channels; with ``watermark`` each has its own and undated rows are counted and left out."""
    frames = [export_stream(spark, ch, d) if watermark is None else
              _watermarked(export_stream(spark, ch, d), watermark, f"undated_{ch}") for ch, d in directories.items() if d]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return with_ratios(out)


def weekly_stream(stream: DataFrame, grain="channel", watermark: str = "14 days") -> DataFrame:
    """Weekly (Monday) exact sums per series over an event-time watermark (the stream's own where it has ``event_ts``)."""
    keys = grain_keys(grain)
    rows = stream if "event_ts" in stream.columns else _watermarked(stream, watermark, "undated")
    g = rows.filter(keys_present(keys)).groupBy(
        *keys, F.window("event_ts", WEEK, WEEK, MONDAY_OFFSET).alias("w")).agg(
        F.sum(exact("spend")).alias("spend_d"), F.sum(exact("revenue")).alias("revenue_d"),
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(exact("conversions")).alias("conversions_d"))
    return g.select(
        *keys, F.to_date(F.col("w.start")).alias("week"),
        F.coalesce(F.col("spend_d").cast("double"), F.lit(0.0)).alias("spend"),
        F.coalesce(F.col("revenue_d").cast("double"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.col("clicks"), F.lit(0)).cast("long").alias("clicks"),
        F.coalesce(F.col("impressions"), F.lit(0)).cast("long").alias("impressions"),
        F.coalesce(F.col("conversions_d").cast("double"), F.lit(0.0)).alias("conversions"),
    ).withColumn("roas", F.coalesce(F.try_divide("revenue", "spend"), F.lit(0.0)))


def run_weekly(spark: SparkSession, directories: Mapping[str, str], output: str, checkpoint: str,
               grain="channel", watermark: str = "14 days", available_now: bool = True):
    """Start the weekly roll-up into a Parquet folder (append mode: a week is
    written once the watermark passes it). Returns the StreamingQuery."""
    weekly = weekly_stream(unified_stream(spark, directories, watermark), grain)
    writer = (weekly.writeStream.format("parquet").option("path", output)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def ingest_report(query: StreamingQuery) -> dict:
    """What a query left out in its recent batches (``spark.sql.streaming.numRecentProgressUpdates``).

    ``undated``: rows without a date with their spend and revenue, by channel.
    ``late``: partial sums (a series' rows of one week in one task) behind the
    watermark; not zero if any row came too late.
    """
    undated: dict[str, dict] = {}
    late = 0
    for p in query.recentProgress:
        late += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        for name, row in p.observedMetrics.items():
            if name.startswith("undated"):
                total = undated.setdefault(name.removeprefix("undated_"), {"rows": 0, "spend": 0.0, "revenue": 0.0})
                for c in total:
                    total[c] += row[c] or 0
    return {"late": late, "undated": undated}
