"""Vendor exports → unified daily rows (Google, Bing, Meta).

Each ``*_to_unified`` takes a DataFrame holding the vendor's own field names,
either typed (Parquet, a view) or all-text (CSV read without inference), and
returns the 13 unified columns. The mapping is a single projection, so Catalyst
prunes the scan to the fields used and pushes filters below it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import campaign_type_from_name, clean_text, nan_to_null, shortest_number
from .schema import (
    BING_CHANNEL,
    BING_REVENUE_SOURCE,
    GOOGLE_CHANNEL,
    GOOGLE_MICROS_PER_UNIT,
    GOOGLE_REVENUE_SOURCE,
    META_CHANNEL,
    META_DEFAULT_FALLBACK_ROAS,
    UNIFIED_COLUMNS,
)


class _Fields:
    """Column types of a raw export, read once (each ``df.schema`` call re-analyses the plan).

    With ``faults`` (a list) unreadable values become null and the list gets an
    expression for each field that can be unreadable: its reason, or null.
    Without it they fail the query.
    """

    def __init__(self, df: DataFrame, faults: list[Column] | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.faults = faults

    def unreadable(self, name: str, kind: str, text: Column, bad: Column, as_type: str) -> Column:
        """What stands for an unreadable value: null with a reason, or an error."""
        if self.faults is None:
            return F.raise_error(F.concat(F.lit(f"{name}: not a {kind}: "), text)).cast(as_type)
        self.faults.append(F.when(bad, F.lit(f"{name}: not a {kind}")))
        return F.lit(None).cast(as_type)

    def __getitem__(self, name: str):
        if name not in self.types:
            raise ValueError(f"export lacks field {name!r}")
        return self.types[name]


def _is_text(df, name: str) -> bool:
    return isinstance(df[name], T.StringType)


def _text(df: _Fields, name: str) -> Column:
    c = F.col(name)
    return clean_text(c) if _is_text(df, name) else c.cast("string")


def _double(df: _Fields, name: str) -> Column:
    if not _is_text(df, name):
        return nan_to_null(F.col(name).cast("double"))
    c = clean_text(F.col(name))
    if df.faults is None:
        return nan_to_null(c.cast("double"))
    number = c.try_cast("double")
    df.unreadable(name, "number", c, c.isNotNull() & number.isNull(), "double")
    return nan_to_null(number)


def _long(df: _Fields, name: str) -> Column:
    if isinstance(df[name], (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(name).cast("long")
    # A count with a fraction is a fault of the export: it is reported instead of being cut.
    c = _double(df, name)
    whole = (c == F.floor(c)) & c.between(-MOST_COUNT, MOST_COUNT)
    fault = df.unreadable(name, "whole number", c.cast("string"), c.isNotNull() & ~whole, "long")
    return F.when(c.isNull() | whole, c.cast("long") if df.faults is None else c.try_cast("long")).otherwise(fault)


MOST_COUNT = 2.0**53  # counts beyond are not exact as numbers of a text export
# Date texts read besides ISO; the month comes first where the order is open.
DATE_PATTERNS = ["M/d/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "yyyyMMdd", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy"]


def _date(df: _Fields, name: str) -> Column:
    if not _is_text(df, name):
        return F.to_date(F.col(name))
    c = F.trim(clean_text(F.col(name)))
    others = [F.try_to_timestamp(c, F.lit(p)).cast("date") for p in DATE_PATTERNS]
    read = F.coalesce(c.try_cast("date"), *others)
    fault = df.unreadable(name, "date", c, c.isNotNull() & read.isNull(), "date")
    return F.when(c.isNotNull(), F.coalesce(read, fault))


def _campaign_id(df: _Fields, name: str) -> Column:
    # A missing id keeps its row (the text "nan"), as the exports are read as text.
    return F.coalesce(_text(df, name), F.lit("nan"))


def google_to_unified(raw: DataFrame) -> DataFrame:
    return raw.select(*_google_columns(_Fields(raw)))


def _google_columns(f: _Fields) -> list[Column]:
    return [
        _date(f, "segments_date").alias("date"),
        F.lit(GOOGLE_CHANNEL).alias("channel"),
        _campaign_id(f, "campaign_id").alias("campaign_id"),
        _text(f, "campaign_name").alias("campaign_name"),
        _text(f, "campaign_advertising_channel_type").alias("campaign_type"),
        (_double(f, "metrics_cost_micros") / F.lit(float(GOOGLE_MICROS_PER_UNIT))).alias("spend"),
        _double(f, "metrics_conversions_value").alias("revenue"),
        _long(f, "metrics_clicks").alias("clicks"),
        _long(f, "metrics_impressions").alias("impressions"),
        _double(f, "metrics_conversions").alias("conversions"),
        _double(f, "campaign_budget_amount").alias("daily_budget"),
        F.lit(False).alias("revenue_is_estimated"),
        F.lit(GOOGLE_REVENUE_SOURCE).alias("revenue_source"),
    ]


def bing_to_unified(raw: DataFrame) -> DataFrame:
    return raw.select(*_bing_columns(_Fields(raw)))


def _bing_columns(f: _Fields) -> list[Column]:
    return [
        _date(f, "TimePeriod").alias("date"),
        F.lit(BING_CHANNEL).alias("channel"),
        _campaign_id(f, "CampaignId").alias("campaign_id"),
        _text(f, "CampaignName").alias("campaign_name"),
        _text(f, "CampaignType").alias("campaign_type"),
        _double(f, "Spend").alias("spend"),
        _double(f, "Revenue").alias("revenue"),
        _long(f, "Clicks").alias("clicks"),
        _long(f, "Impressions").alias("impressions"),
        _double(f, "Conversions").alias("conversions"),
        _double(f, "DailyBudget").alias("daily_budget"),
        F.lit(False).alias("revenue_is_estimated"),
        F.lit(BING_REVENUE_SOURCE).alias("revenue_source"),
    ]


def meta_revenue(raw, estimated_aov: float | None = None,
                 fallback_roas: float = META_DEFAULT_FALLBACK_ROAS) -> tuple[Column, bool, str]:
    """Revenue expression, estimated flag and source label, chosen by the columns present.

    Order: an observed ``revenue`` field; else conversions × ``conversion_value``;
    else conversions × the supplied average order value; else spend × fallback ROAS.
    """
    f = raw if isinstance(raw, _Fields) else _Fields(raw)
    cols = set(f.types)
    conversions = _double(f, "conversion")
    if "revenue" in cols:
        return _double(f, "revenue"), False, "revenue"
    if "conversion_value" in cols:
        return conversions * _double(f, "conversion_value"), False, "conversion_value"
    if estimated_aov is not None:
        return conversions * F.lit(float(estimated_aov)), True, f"estimated_aov_{shortest_number(estimated_aov)}"
    return (_double(f, "spend") * F.lit(float(fallback_roas)), True,
            f"fallback_roas_{shortest_number(fallback_roas)}")


def meta_to_unified(raw: DataFrame, estimated_aov: float | None = None,
                    fallback_roas: float = META_DEFAULT_FALLBACK_ROAS) -> DataFrame:
    return raw.select(*_meta_columns(_Fields(raw), estimated_aov, fallback_roas))


def _meta_columns(f: _Fields, estimated_aov: float | None = None,
                  fallback_roas: float = META_DEFAULT_FALLBACK_ROAS) -> list[Column]:
    revenue, estimated, source = meta_revenue(f, estimated_aov, fallback_roas)
    return meta_columns(f, revenue, F.lit(estimated), F.lit(source))


def meta_columns(raw, revenue: Column, estimated: Column, source: Column) -> list[Column]:
    """The unified columns of a Meta export, given how its revenue is found."""
    f = raw if isinstance(raw, _Fields) else _Fields(raw)
    name = _text(f, "campaign_name")
    return [
        _date(f, "date_start").alias("date"),
        F.lit(META_CHANNEL).alias("channel"),
        _campaign_id(f, "campaign_id").alias("campaign_id"),
        name.alias("campaign_name"),
        campaign_type_from_name(name).alias("campaign_type"),
        _double(f, "spend").alias("spend"),
        revenue.alias("revenue"),
        _long(f, "clicks").alias("clicks"),
        _long(f, "impressions").alias("impressions"),
        _double(f, "conversion").alias("conversions"),
        _double(f, "daily_budget").alias("daily_budget"),
        estimated.alias("revenue_is_estimated"),
        source.alias("revenue_source"),
    ]


MAPPERS = {
    GOOGLE_CHANNEL: google_to_unified,
    BING_CHANNEL: bing_to_unified,
    META_CHANNEL: meta_to_unified,
}
_COLUMNS = {GOOGLE_CHANNEL: _google_columns, BING_CHANNEL: _bing_columns, META_CHANNEL: _meta_columns}
REASONS, RAW = "reject_reasons", "raw_row"


def parse_lenient(raw: DataFrame, channel: str, counts: Observation | None = None, **options) -> DataFrame:
    """Unified rows of an export, each with the reasons why it is rejected and its raw fields.

    Every row of ``raw`` gives one row: ``reject_reasons`` is null for good ones,
    else an array of reasons (unreadable date, number that is none, count with a
    fraction) and ``raw_row`` the export's fields as JSON text. Missing values are
    no fault. ``counts`` observes ``rows`` and ``rejected`` while the rows pass by;
    :func:`split_rejects` or ``sinks.write_parsed`` parts good rows from rejects.
    """
    faults: list[Column] = []
    columns = _COLUMNS[channel](_Fields(raw, faults), **options)
    reasons = F.array_distinct(F.array_compact(F.array(*faults))) if faults else F.array().cast("array<string>")
    bad = F.size(REASONS) > 0
    rows = raw.select(*columns, reasons.alias(REASONS), F.struct("*").alias(RAW)).withColumns({
        REASONS: F.when(bad, F.col(REASONS)), RAW: F.when(bad, F.to_json(RAW, {"ignoreNullFields": "false"}))})
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("rows"), F.count(REASONS).alias("rejected"))
    return rows


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good unified rows, rejects) of :func:`parse_lenient`."""
    good = parsed.where(F.col(REASONS).isNull()).drop(REASONS, RAW)
    return good, parsed.where(F.col(REASONS).isNotNull()).select("channel", REASONS, RAW)


def load_lenient(spark: SparkSession, channel: str, path, counts: Observation | None = None, **options) -> DataFrame:
    """:func:`parse_lenient` of CSV exports; each header is mapped by itself."""
    parts = [parse_lenient(raw, channel, **options) for raw in read_exports(spark, path)]
    rows = reduce(DataFrame.unionByName, parts)
    if counts is not None:
        rows = rows.observe(counts, F.count(F.lit(1)).alias("rows"), F.count(REASONS).alias("rejected"))
    return rows


BLANK = "".join(map(chr, range(33)))  # what Spark trims
WILDCARDS = re.compile(r"[*?\[\]{}\\]")


def _header(spark: SparkSession, uri: str) -> tuple[str, tuple[str, ...]]:
    """(path, header) of one CSV file; leading blank lines are skipped as Spark does, a file of blank lines has no header."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        source = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
        line = (reader.readLine() or "").removeprefix("\ufeff")
        while line is not None and not line.strip(BLANK):
            line = reader.readLine()
    finally:
        stream.close()
    return path.toString(), tuple(next(csv.reader([line]), ())) if line else ()


def _partition_base(spark: SparkSession, path: str) -> str:
    """The folder below which ``name=value`` folders are columns: before the first wildcard, or a file's own."""
    fixed = re.split(r"(?:^|/)[^/]*[*?\[{]", path)[0] or ("/" if path.startswith("/") else ".")
    p = spark._jvm.org.apache.hadoop.fs.Path(fixed)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return (p.getParent() if status.isFile() else p).toString()


def export_headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of an export by their header, for files, directories and globs.

    Only the first line with content of each file is read, as a Parquet reader
    reads footers; no rows reach the driver. Files without content are left out.
    """
    uris = sorted(spark.read.text(path).inputFiles())
    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(32) as pool:
        for file, header in pool.map(lambda u: _header(spark, u), uris):
            if header:
                groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError(f"no CSV file with a header in {path!r}")
    return groups


def text_schema(header: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in header])


def read_exports(spark: SparkSession, path: str | list[str]) -> list[DataFrame]:
    """CSV export(s) as text columns, one frame for each header that occurs.

    Every field is text so ids keep their digits and missing tokens are mapped
    by the mapping step. Files may differ in column order and extra columns;
    each is read by its own header, which Spark compares again while reading.
    The files listed are read, whatever the number of headers; ``name=value``
    folders below a path are columns.
    """
    groups = export_headers(spark, path)
    reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    if any("=" in file for files in groups.values() for file in files):
        based = [(_partition_base(spark, p), export_headers(spark, p)) for p in ([path] if isinstance(path, str) else path)]
    else:
        based = [(None, groups)]
    return [
        (reader.option("basePath", base) if base else reader).schema(text_schema(header)).csv([WILDCARDS.sub(r"\\\g<0>", f) for f in files])
        for base, found in based for header, files in found.items()
    ]


def read_export_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All rows of :func:`read_exports` by column name; a column that a file lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read_exports(spark, path))


def _mapped(spark: SparkSession, path, mapper: Callable[..., DataFrame], **options) -> DataFrame:
    # Each header is mapped by itself: which fields there are decides how Meta revenue is found.
    return reduce(DataFrame.unionByName, [mapper(raw, **options) for raw in read_exports(spark, path)])


def load_google(spark: SparkSession, path) -> DataFrame:
    return _mapped(spark, path, google_to_unified)


def load_bing(spark: SparkSession, path) -> DataFrame:
    return _mapped(spark, path, bing_to_unified)


def load_meta(spark: SparkSession, path, estimated_aov: float | None = None,
              fallback_roas: float = META_DEFAULT_FALLBACK_ROAS) -> DataFrame:
    return _mapped(spark, path, meta_to_unified, estimated_aov=estimated_aov, fallback_roas=fallback_roas)


def load_channels(spark: SparkSession, inputs: Mapping[str, object],
                  required: tuple[str, ...] = (GOOGLE_CHANNEL,),
                  meta_options: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
    """Source selection: ``{channel: path | raw DataFrame | None}`` → unified frames.

    A required channel without an input is an error; absent optional channels are
    simply left out, so the union is built only from supplied inputs.
    """
    out: dict[str, DataFrame] = {}
    for channel in required:
        if inputs.get(channel) is None:
            raise ValueError(f"missing required input for channel {channel!r}")
    for channel, src in inputs.items():
        if src is None:
            continue
        if channel not in MAPPERS:
            raise ValueError(f"unknown channel {channel!r}")
        options = dict(meta_options or {}) if channel == META_CHANNEL else {}
        if isinstance(src, DataFrame):
            out[channel] = MAPPERS[channel](src, **options)
        else:
            out[channel] = _mapped(spark, src, MAPPERS[channel], **options)
    return out


def conform(df: DataFrame) -> DataFrame:
    """Projection to the unified column set and order (error if one is missing)."""
    return df.select(*UNIFIED_COLUMNS)
