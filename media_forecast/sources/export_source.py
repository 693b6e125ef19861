"""Vendor CSV exports as a Spark data source that reads every file by its own header, in the task.

``spark.read.format("vendor_export").option("channel", "Meta").load(folder)``
plans one partition per range of a file. The driver lists files and opens
none; a task reads the header of its file and then its range, so a folder may
hold millions of files in any mixture of column orders. The same source
streams: files that arrive later may have another header.

Rows have the channel's fields as text, null where the file lacks one, and
``export_fields``, the fields that the file has: which are there decides how Meta
revenue is found (:func:`load_vendor_export`).

Paths: files, folders (read with their subfolders, without names that begin with
``_`` or ``.``) and globs of any store that pyarrow's file systems reach; stores
that only Hadoop reaches are read by ``vendors.load_*``. Lines end a row, also
inside quotes, as with Spark's reader. Compressed files are one range. A stream
takes files in the order of (time of change, name): a file must appear whole and
not be older than one already read. Files without content give no rows.
"""

from __future__ import annotations

import csv
import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timezone

import pyarrow as pa
from pyarrow import csv as pacsv
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship_package
from .schema import BING_CHANNEL, BING_FIELDS, GOOGLE_CHANNEL, GOOGLE_FIELDS, META_CHANNEL, META_FIELDS
from .vendors import BLANK, MAPPERS, meta_columns, meta_revenue

FORMAT = "vendor_export"
RANGE_BYTES = 32 << 20
REQUIRED = {GOOGLE_CHANNEL: list(GOOGLE_FIELDS), BING_CHANNEL: list(BING_FIELDS), META_CHANNEL: list(META_FIELDS)}
OPTIONAL = {META_CHANNEL: ["revenue", "conversion_value"]}
PACKED = (".gz", ".bz2", ".zst", ".lz4")


def fields_of(channel: str) -> list[str]:
    return REQUIRED[channel] + OPTIONAL.get(channel, [])


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int | None  # None: the whole of a compressed file


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI; names may hold any sign, they are not URI-escaped."""
    uri = re.match(r"([a-z][a-z0-9+.-]*):(?://([^/]*))?(.*)", path, re.DOTALL)
    if uri is None or uri[1] == "file":
        return fs.LocalFileSystem(), path if uri is None else "/" + uri[3].lstrip("/")
    store, root = fs.FileSystem.from_uri(f"{uri[1]}://{uri[2] or ''}/")
    return store, root.rstrip("/") + uri[3]


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change in nanoseconds) of the files below ``path``; nothing is opened."""
    store, inner = store_of(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    fixed = re.split(r"/[^/]*[*?\[]", inner)[0] or "/"
    info = store.get_file_info(fixed)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(fixed, recursive=True))
    out = []
    for f in found:
        below = f.path[len(fixed):].strip("/").split("/")
        if f.type != fs.FileType.File or any(x.startswith(("_", ".")) for x in below if x):
            continue
        if fixed != inner and not (fnmatch.fnmatchcase(f.path, inner) or fnmatch.fnmatchcase(f.path, inner.rstrip("/") + "/*")):
            continue
        out.append((prefix + f.path, f.size, int(f.mtime.replace(tzinfo=f.mtime.tzinfo or timezone.utc).timestamp() * 1e9) if f.mtime else 0))
    return sorted(out)


def ranges(files: list[tuple[str, int, int]], size: int) -> list[FileRange]:
    out = []
    for path, length, _ in files:
        if path.endswith(PACKED):
            out.append(FileRange(path, 0, None))
        else:
            out += [FileRange(path, k, min(k + size, length)) for k in range(0, length, size)]
    return out


def header_of(lines: Iterator[bytes]) -> tuple[list[str], int]:
    """(fields, bytes up to the first data row) from a file's first lines; leading blank lines are skipped."""
    used = 0
    for line in lines:
        used += len(line)
        text = line.decode("utf-8").removeprefix("\ufeff")
        if text.strip(BLANK):
            return next(csv.reader([text.rstrip("\r\n")])), used
    return [], used


def lines_of(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(chunk):
        *whole, rest = (rest + block).split(b"\n")
        yield from (line + b"\n" for line in whole)
    if rest:
        yield rest


def range_bytes(file, start: int, end: int) -> bytes:
    """The rows that begin in [start, end): from the first row border on, to the end of the last row."""
    file.seek(max(0, start - 1))
    raw = file.read(end - max(0, start - 1))
    if start > 0:
        cut = raw.find(b"\n")
        if cut < 0 or cut + 1 > end - start + 1:
            return b""
        raw = raw[cut + 1:]
    if raw and not raw.endswith(b"\n"):
        tail = []
        while block := file.read(1 << 16):
            cut = block.find(b"\n")
            tail.append(block if cut < 0 else block[: cut + 1])
            if cut >= 0:
                break
        raw += b"".join(tail)
    return raw


def rows_of(part: FileRange, channel: str) -> Iterator[pa.RecordBatch]:
    """Text columns of the rows in a range."""
    store, inner = store_of(part.path)
    if part.end is None:
        with store.open_input_stream(inner, compression="detect") as stream:
            raw = stream.read()
        fields, used = header_of(iter(raw.splitlines(keepends=True)))
        raw = raw[used:]
    else:
        with store.open_input_file(inner) as file:
            fields, used = header_of(lines_of(file))
            raw = range_bytes(file, max(part.start, used), part.end) if part.end > used else b""
    if not fields or not raw.strip(BLANK.encode()):
        return
    missing = [c for c in REQUIRED[channel] if c not in fields]
    if missing:
        raise ValueError(f"{part.path}: export lacks fields {missing}")
    wanted = fields_of(channel)
    table = pacsv.open_csv(
        pa.BufferReader(raw), read_options=pacsv.ReadOptions(column_names=fields),
        parse_options=pacsv.ParseOptions(escape_char="\\", ignore_empty_lines=True),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(fields, pa.string()), include_columns=[c for c in wanted if c in fields]),
    )
    for batch in table:
        n = batch.num_rows
        columns = [batch.column(c) if c in fields else pa.nulls(n, pa.string()) for c in wanted]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([fields] * n, pa.list_(pa.string()))], [*wanted, "export_fields"])


class _Ranges:
    def __init__(self, options: dict):
        self.channel, self.path = options["channel"], options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        if self.channel not in REQUIRED:
            raise ValueError(f"unknown channel {self.channel!r}")

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.channel)


class ExportReader(_Ranges, DataSourceReader):
    def partitions(self) -> list[FileRange]:
        return ranges(listed(self.path), self.size) or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.channel) if partition.path else iter(())


class ExportStreamReader(_Ranges, DataSourceStreamReader):
    """Offsets are (time of change, name) of the last file taken."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        _, _, changed, path = max(((t, p, t, p) for p, _, t in listed(self.path)), default=(0, "", -1, ""))
        return {"changed": changed, "path": path}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return ranges([f for f in listed(self.path) if after < (f[2], f[0]) <= upto], self.size)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in fields_of(self.options["channel"])) + ", export_fields array<string>"

    def reader(self, schema) -> ExportReader:
        return ExportReader(self.options)

    def streamReader(self, schema) -> ExportStreamReader:
        return ExportStreamReader(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ExportSource)


def unified_of(raw: DataFrame, channel: str, **options) -> DataFrame:
    """Unified rows of this source's rows. Meta revenue follows the fields of each row's own file."""
    if channel != META_CHANNEL:
        return MAPPERS[channel](raw.drop("export_fields"))
    kinds = [[], ["revenue"], ["revenue", "conversion_value"]]  # optional fields that files of a kind lack
    revenue, estimated, source = zip(*(meta_revenue(raw.drop(*lacking), **options) for lacking in kinds), strict=True)

    def of_file(choices):
        first, second, third = (c if isinstance(c, Column) else F.lit(c) for c in choices)
        return F.when(F.array_contains("export_fields", "revenue"), first).when(
            F.array_contains("export_fields", "conversion_value"), second).otherwise(third)

    return raw.select(*meta_columns(raw, of_file(revenue), of_file(estimated), of_file(source)))


def load_vendor_export(spark: SparkSession, channel: str, path: str, **options) -> DataFrame:
    """Unified rows of the exports below ``path``; headers are read by the tasks."""
    register(spark)
    raw = spark.read.format(FORMAT).option("channel", channel).option("path", path).load()
    return unified_of(raw, channel, **options)


def stream_vendor_export(spark: SparkSession, channel: str, path: str, **options) -> DataFrame:
    """:func:`load_vendor_export` as a stream of files that arrive, each read by its own header."""
    register(spark)
    raw = spark.readStream.format(FORMAT).option("channel", channel).option("path", path).load()
    return unified_of(raw, channel, **options)
