"""Operator 9: best-fit packing planned on the histogram of lengths.

1. Every document is encoded once; documents longer than a sequence are cut
   into whole pieces and a last shorter one. The pieces (ids, not texts, are
   gone by then) are stored.
2. The histogram of lengths has at most ``capacity`` rows whatever the corpus
   size. Best-fit decreasing runs on its counts: all sequences with the same
   free space form one group, and a length fills whole groups at a time.
3. The plan is a table of runs: ranks [lo, hi) within a length go to
   consecutive sequences of a group. Pieces take their slots by joining on
   rank within length. Ranks are numbered per stored partition and shifted by
   the counts of the partitions before, so a length that most pieces share is
   not ranked in one task.

Null text counts as empty and packs as the end id alone. Repeated rows are
packed each. Extra columns are ignored. An empty table packs into no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from media_forecast.llm.bpe import VOCAB, vocabulary
from media_forecast.llm.common import stored
from media_forecast.shipping import ship_package

CAPACITY = 4096
END_ID = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocab: str = VOCAB) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids with the end id behind them."""
    ship_package(docs.sparkSession)
    tail = END_ID.to_bytes(4, "little")

    def run(batches):
        v = vocabulary(public_tokenizers.path(vocab), with_text=False)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                raw = v.id_bytes(text) + tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at: at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, lo, hi, first_sequence, per_sequence, offset).

    Rank r in [lo, hi) of a length goes to sequence ``first + (r - lo) // per``
    at place ``offset + (r - lo) % per * length``. Groups are runs of sequences
    with equal free space, so the work follows the number of distinct lengths.
    """
    rows = []
    free: list[int] = []  # distinct free spaces, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, sequences)
    opened = 0

    def put(space: int, first: int, count: int) -> None:
        if space not in groups:
            groups[space] = []
            insort(free, space)
        groups[space].append((first, count))

    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(free, length)
            if k < len(free):
                space = free[k]
                first, count = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    free.pop(k)
            else:
                space, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            per = space // length
            full = min(count, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, capacity - space))
                put(space - per * length, first, full)
                rank += full * per
                left -= full * per
            if full < count and left and left < per:
                rows.append((length, rank, rank + left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                put(space, first + full, count - full)
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, vocab: str = VOCAB) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    cut = stored(pieces(docs, capacity, vocab).withColumn("pid", F.spark_partition_id()), "pieces")
    counts = cut.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = cut.sparkSession.createDataFrame(
        [(*row,) for row in plan(histogram, capacity)],
        "length long, lo long, hi long, first_sequence long, per_sequence long, at long",
    )
    shift = counts.select(
        "pid", "length",
        (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("shift"),
    )
    local = F.row_number().over(Window.partitionBy("pid", "length").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("local", local).join(shift, ["pid", "length"]).withColumn("rank", F.col("local") + F.col("shift"))
    r = F.col("rank") - F.col("lo")
    # The plan has a few rows for each of at most ``capacity`` lengths: its size does not follow the corpus.
    return (
        ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1))
        .select(
            "doc_id", "piece", "start", ranked["length"], "ids_crc32",
            (F.col("first_sequence") + F.floor(r / F.col("per_sequence"))).alias("sequence_id"),
            (F.col("at") + F.pmod(r, F.col("per_sequence")) * ranked["length"]).alias("offset"),
        )
    )
