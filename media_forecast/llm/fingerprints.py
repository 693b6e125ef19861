"""Operator 4: context-triggered piecewise hashing.

A rolling hash over the last ``SPAN`` bytes ends a chunk wherever it is one
less than a multiple of the block size. Every chunk gives one of 64 signs from
the hash of its bytes. Block sizes are ``3 * 2**k``; the smallest one follows
the text's length, so that about ``SIGNS`` to ``2 * SIGNS`` chunks are expected;
a text that repeats itself into more than ``MOST`` chunks takes the next size. A
signature always covers the whole text, and the borders of a block size are
among those of the one below. A fingerprint is ``size:signature:signature at
twice the size:signature at four times the size``.

Likeness of two fingerprints is taken at a block size that both have: one minus
the edit distance (insertions and deletions) over both lengths, the larger of
the sizes they share. Without a common run of ``RUN`` signs (a third of a short
signature, two at least) it is 0. Equal fingerprints have likeness 1.

The edited text of a document needs the next document by ascending doc_id.
Documents are dealt into ranges of doc_id; the first document of each range
also goes to the range before (the very first one to the last), so each range
is read through once in order. Null doc_ids come first; equal ids are ordered
by text. Null text counts as empty. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from media_forecast.llm.common import mix64, shuffle_width
from media_forecast.shipping import ship_package

SPAN = 7  # bytes of the rolling hash
SMALLEST = 3
SIGNS = 64
MOST = 4 * SIGNS
RUN = 5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIGN = np.frombuffer(ALPHABET.encode(), np.uint8)
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the chunk hash


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last SPAN bytes at every place (fewer at the start)."""
    h = np.zeros(len(data), np.uint32)
    x = data.astype(np.uint32) + np.uint32(1)
    for j in range(min(SPAN, len(data))):
        h[j:] += x[: len(x) - j] * np.uint32(pow(0x01000193, j + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the chunk hash's multiplier; kept by the worker for the longest chunk so far."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[:n]


def signature(data: np.ndarray, ends: np.ndarray) -> str:
    """One sign per chunk; ``ends`` are the last places of the chunks but the text's last."""
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(data)]
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[place]
    return _SIGN[(mix64(np.add.reduceat(terms, starts)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    size = SMALLEST
    if not len(data):
        return f"{size}:::"
    while size * 2 * SIGNS < len(data):
        size *= 2
    with np.errstate(over="ignore"):
        h = rolling(data)
        ends = np.flatnonzero(h % np.uint32(size) == size - 1)
        while len(ends) >= MOST:
            size *= 2
            ends = ends[h[ends] % np.uint32(size) == size - 1]
        marks = []
        for scale in (1, 2, 4):
            ends = ends[h[ends] % np.uint32(scale * size) == scale * size - 1]
            marks.append(signature(data, ends))
    return f"{size}:" + ":".join(marks)


def common_run(a: str, b: str) -> bool:
    n = min(RUN, max(2, min(len(a), len(b)) // 3))
    runs = {a[i: i + n] for i in range(len(a) - n + 1)}
    return any(b[i: i + n] in runs for i in range(len(b) - n + 1))


def likeness_of_signatures(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not common_run(a, b):
        return 0.0
    # Longest common subsequence, one machine word of bits per row.
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 0 if the block sizes are not compatible."""
    if x == y:
        return 1.0
    (p, *a), (q, *b) = x.split(":"), y.split(":")
    at = {int(q) << k: mark for k, mark in enumerate(b)}
    shared = [(mark, at[int(p) << k]) for k, mark in enumerate(a) if int(p) << k in at]
    best = max((likeness_of_signatures(m, n) for m, n in shared if m or n), default=0.0)
    return min(best, 0.999999)  # only equal fingerprints have 1


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, doc_id, text, extra): rows of each range, and as ``extra`` the first row of the range after it."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.approxQuantile("doc_id", probabilities, 0.25 / ranges))) if probabilities else []
    part = F.lit(0)
    if cuts:
        # Number of cuts below the id, by binary search in a constant array.
        bounds = F.array(*[F.lit(int(c)) for c in cuts])
        part = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("part", part)
    low = F.struct(F.col("doc_id"), F.sha2("text", 256).alias("key"))
    firsts = sorted((r for r in rows.groupBy("part").agg(F.min(low).alias("low")).collect()), key=lambda r: r["part"])
    if not firsts:
        return rows.withColumn("extra", F.lit(False))
    # One entry per range, whatever the table's size: the range before takes a copy of this range's first row.
    before = {r["part"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
    target = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    first_id = F.create_map(*[F.lit(x) for r in firsts for x in (r["part"], r["low"]["doc_id"])])
    first_key = F.create_map(*[F.lit(x) for r in firsts for x in (r["part"], r["low"]["key"])])
    is_first = first_id[F.col("part")].eqNullSafe(F.col("doc_id"))
    is_first = F.when(is_first, F.sha2("text", 256) == first_key[F.col("part")]).otherwise(False)
    homes = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")))
    copies = F.when(
        is_first, F.concat(homes, F.array(F.struct(target[F.col("part")].alias("part"), F.lit(True).alias("extra"))))
    ).otherwise(homes)
    return rows.select("doc_id", "text", F.explode(copies).alias("home")).select("home.part", "doc_id", "text", "home.extra")


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, and likenesses to it and to the next document's."""
    ship_package(docs.sparkSession)
    ranges = ranges or shuffle_width(docs)
    rows = in_ranges(docs, ranges)

    def run(batches):
        held = None  # (part, doc_id, text, fingerprint) that waits for its follower
        for b in batches:
            out = []
            for part, doc, text, extra in zip(b["part"], b["doc_id"], b["text"], b["extra"], strict=True):
                if extra and (held is None or held[0] != part):
                    continue  # a further copy of a first row that the range already used
                mark = fingerprint(text)
                if held is not None:
                    changed = edited(held[2], text)
                    other = fingerprint(changed)
                    out.append((
                        held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8")).hexdigest(), held[3], other,
                        likeness(held[3], other), likeness(held[3], mark),
                    ))
                held = None if extra else (part, doc, text, mark)
            yield pd.DataFrame({
                name: pd.Series([r[i] for r in out], dtype=kind)
                for i, (name, kind) in enumerate(FIELDS.items())
            })

    dealt = rows.repartition(ranges, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), F.sha2("text", 256))
    return dealt.select("part", "doc_id", "text", "extra").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )


FIELDS = {
    "doc_id": "Int64", "n_chars": "int64", "edited_sha256": "object", "fingerprint": "object",
    "edited_fingerprint": "object", "near_edited": "float64", "near_next": "float64",
}
