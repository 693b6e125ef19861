"""Operator 10: removal of repeated 100-byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a document of smaller doc_id, or earlier in the same one. The suffix order
of the whole corpus is built in parts that hold every equal string together:

1. Of each string the smallest hash of its ``GRAM``-byte grams is taken (a
   sliding minimum). Equal strings have equal minima, and neighbouring strings
   mostly share theirs, so a document falls into runs of one minimum each.
2. Minima that occur in one run of one text only belong to no repeated string.
   They are dropped by hash range, each distinct text counted once.
3. The runs left send their bytes to the hash range of their minimum. Runs of
   equal bytes are collapsed there, and in the sending task already: all but
   the first are covered.
4. Of the distinct runs the suffixes are ranked by their first ``LENGTH`` bytes
   (prefix doubling). Along the suffix order the longest previous factor of a
   suffix reaches ``LENGTH`` if the previous or the next smaller position
   among its neighbours agrees in that many bytes.

Of texts with equal bytes only the one of smallest doc_id is looked at; the
others are covered wholly (if they have ``LENGTH`` bytes). Null text counts as
empty. Rows of equal doc_id are never earlier than each other. Null doc_ids
come first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from media_forecast.llm.common import mix64, shuffle_width, stored
from media_forecast.shipping import ship_package

LENGTH, GRAM = 100, 20
WHOLE, SPANS = "__whole", "__spans"
BLOCK = 1 << 20  # bytes of a text handled at once
FLUSH = 8_000_000  # bytes that a task holds before it sends them on
RANKED = 2_000_000  # bytes of runs whose suffixes are ranked together; one minimum's runs are never split
KEY_SEED = 42  # of Spark's xxhash64


def text_key(raw: bytes) -> int:
    """What xxhash64(text) gives in Spark."""
    return int(np.uint64(xxhash.xxh64_intdigest(raw, KEY_SEED)).astype(np.int64))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    return x[:n] if have == width else pick(x[:n], x[width - have: width - have + n])


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, first string, strings, repeats) of each run; repeats: its gram occurs again within a string's reach."""
    parts = []
    step = LENGTH - GRAM + 1
    for lo in range(0, len(raw) - LENGTH + 1, BLOCK):
        piece = raw[lo: lo + BLOCK + LENGTH - 1]
        n = len(piece) - GRAM + 1
        word = np.ndarray((len(piece) - 7,), "<u8", piece, strides=(1,))
        gram = mix64(word[:n] * np.uint64(0x9E3779B97F4A7C15) + mix64(word[8: 8 + n])) ^ word[GRAM - 8: GRAM - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
        gram = mix64(gram)
        low = sliding(gram, step, np.minimum)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.diff(np.concatenate([first, [len(low)]]))
        # A gram is a minimum if the largest minimum of the strings around it is its own hash.
        around = np.concatenate([np.full(step - 1, low[0]), low, np.full(step - 1, low[-1])])
        at = np.flatnonzero(gram == sliding(around, step, np.maximum)[:n])
        value = gram[at]
        again = value[1:][(value[1:] == value[:-1]) & (np.diff(at) < step)]
        repeats = np.isin(low[first], again) if len(again) else np.zeros(len(first), bool)
        parts.append((low[first], first + lo, count, repeats))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bucket_of(low: np.ndarray, buckets: int) -> np.ndarray:
    """Even hash ranges: minima themselves crowd at the low end, so they are hashed once more."""
    return ((mix64(low) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def minima(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, low, owner, many, keys): the distinct minima of many texts in one hash range."""

    def run(batches):
        held, keys, size = [], {}, 0

        def flush():
            low = np.concatenate([h[0] for h in held])
            many = np.concatenate([h[1] for h in held])
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[0]) for h in held])
            names = np.array(list(keys), np.int64)
            bucket = bucket_of(low, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low, many, owner = low[order], many[order], owner[order]
            rows = []
            for k in range(buckets):
                lo, hi = cuts[k], cuts[k + 1]
                if lo < hi:
                    own, local = np.unique(owner[lo:hi], return_inverse=True)
                    rows.append((k, low[lo:hi].tobytes(), local.astype("<i4").tobytes(), many[lo:hi].tobytes(), names[own].tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "low", "owner", "many", "keys"])

        for b in batches:
            for t in b["text"]:
                raw = (t or "").encode("utf-8")
                if len(raw) < LENGTH or (key := text_key(raw)) in keys:
                    continue
                low, _, _, repeats = runs(raw)
                distinct, back, times = np.unique(low, return_inverse=True, return_counts=True)
                many = times > 1
                np.logical_or.at(many, back, repeats)
                keys[key] = None
                held.append((distinct, many.astype(np.uint8)))
                size += len(distinct)
                if size >= FLUSH // 8:
                    yield flush()
                    held, keys, size = [], {}, 0
        if held:
            yield flush()

    return texts.select("text").mapInPandas(run, "bucket int, low binary, owner binary, many binary, keys binary")


def repeated_minima(parts: DataFrame) -> DataFrame:
    """(key, low): the minima of a text that another text or another place of it has."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["low"]])
        many = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["many"]])
        key = np.concatenate([np.frombuffer(k, np.int64)[np.frombuffer(o, "<i4")] for k, o in zip(pdf["keys"], pdf["owner"], strict=True)])
        order = np.lexsort((key, low))
        low, many, key = low[order], many[order], key[order]
        fresh = np.ones(len(low), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (key[1:] != key[:-1])  # copies of a text count once
        low, many, key = low[fresh], many[fresh], key[fresh]
        keep = many > 0
        same = low[1:] == low[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        return pd.DataFrame({"key": key[keep], "low": low[keep].astype(np.int64)})

    return parts.groupBy("bucket").applyInPandas(count, "key long, low long")


def segments(firsts: DataFrame, buckets: int) -> DataFrame:
    """The repeated runs of ``firsts(__id, __key, text, __lows, ...)``; without bytes where the sending task had them earlier."""

    def run(batches):
        held: dict[tuple, list] = {}  # (minimum, bytes) -> places (doc, key, first string, strings, repeats)
        size = 0

        def flush():
            rows = []
            for (low, seg), places in held.items():
                places.sort()
                head = places[0]
                for p in places:
                    own = p is head or p[0] == head[0] and p[1] != head[1]
                    rows.append((low, *p, seg if own else None))
            out = pd.DataFrame(rows, columns=["low", "doc_id", "key", "first", "strings", "repeats", "seg"])
            return out.assign(bucket=bucket_of(out["low"].to_numpy(np.int64).astype(np.uint64), buckets))[COLUMNS]

        for b in batches:
            for doc, key, text, lows in zip(b["__id"], b["__key"], b["text"], b["__lows"], strict=True):
                raw = (text or "").encode("utf-8")
                low, first, count, repeats = runs(raw)
                low = low.astype(np.int64)
                for i in np.flatnonzero(np.isin(low, lows)):
                    s, c = int(first[i]), int(count[i])
                    seg = raw[s: s + c + LENGTH - 1]
                    places = held.setdefault((int(low[i]), seg), [])
                    places.append((doc, key, s, c, bool(repeats[i])))
                    size += 60 + (len(seg) if len(places) == 1 else 0)
                if size >= FLUSH:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return firsts.mapInPandas(
        run, "bucket int, low long, doc_id long, key long, first long, strings int, repeats boolean, seg binary"
    )


COLUMNS = ["bucket", "low", "doc_id", "key", "first", "strings", "repeats", "seg"]


def prefix_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of every place by its next LENGTH bytes (places with fewer have none): prefix doubling."""
    view = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    rank = np.unique(view.astype(np.uint64), return_inverse=True)[1].astype(np.uint32)
    have = 8
    while have < LENGTH:
        shift = min(have, LENGTH - have)
        pair = (rank[: len(rank) - shift].astype(np.uint64) << np.uint64(32)) | rank[shift:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint32)
        have += shift
    return rank


def covered_strings(segs: list[bytes], doc: np.ndarray, key: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, first, last) of runs of strings whose longest previous factor has LENGTH bytes."""
    sizes = np.array([len(s) for s in segs])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rank = prefix_ranks(np.frombuffer(b"".join(segs), np.uint8))
    strings = sizes - LENGTH + 1
    seg = np.repeat(np.arange(len(segs)), strings)
    place = np.arange(len(seg)) - np.repeat(np.concatenate([[0], np.cumsum(strings)[:-1]]), strings)
    r, pos = rank[begin[seg] + place], first[seg] + place
    # Suffix order, places of equal prefix by position: the previous smaller position that agrees is the neighbour.
    order = np.lexsort((pos, key[seg], doc[seg], r))
    r, d, k = r[order], doc[seg][order], key[seg][order]
    head = np.concatenate([[True], r[1:] != r[:-1]])
    smallest = d[np.maximum.accumulate(np.where(head, np.arange(len(r)), 0))]
    before = np.zeros(len(r), bool)
    before[1:] = ~head[1:] & (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    hit = np.zeros(len(r), bool)
    hit[order] = before | (d > smallest)
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.concatenate([[True], (np.diff(at) > 1) | (seg[at][1:] != seg[at][:-1])])
    starts = at[cut]
    ends = at[np.concatenate([cut[1:], [True]])]
    return list(zip(seg[starts].tolist(), place[starts].tolist(), place[ends].tolist(), strict=True))


def covered(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, key, start, end) of the covered bytes that the runs of one hash range show."""
    out = []
    held: dict[tuple, list] = {}
    for low, doc, key, first, count, repeats, seg in zip(*(pdf[c] for c in COLUMNS[1:]), strict=True):
        if seg is None:
            out.append((doc, key, first, first + count - 1 + LENGTH))
        else:
            held.setdefault((low, seg), []).append((doc, key, first, count, repeats))
    kept: dict[int, list] = {}
    for (low, seg), places in held.items():
        places.sort()
        head = places[0]
        for p in places:
            if p is head or p[0] == head[0] and p[1] != head[1]:
                kept.setdefault(low, []).append((seg, p))
            else:
                out.append((p[0], p[1], p[2], p[2] + p[3] - 1 + LENGTH))
    # Equal strings have equal minima: minima are ranked together up to about RANKED bytes, and never split.
    part: list[tuple] = []
    size = 0

    def rank_part() -> None:
        doc, key, first = (np.array([p[j] for _, p in part], np.int64) for j in range(3))
        for s, a, b in covered_strings([seg for seg, _ in part], doc, key, first):
            out.append((doc[s], key[s], first[s] + a, first[s] + b + LENGTH))

    for group in kept.values():
        if len(group) == 1 and not group[0][1][4]:
            continue
        part += group
        size += sum(len(seg) for seg, _ in group)
        if size >= RANKED:
            rank_part()
            part, size = [], 0
    if part:
        rank_part()
    return pd.DataFrame(out, columns=["doc_id", "key", "start", "end"])


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def removals(docs: DataFrame) -> DataFrame:
    """``docs`` with columns WHOLE, whether all of a row's text goes, and SPANS, else its covered byte spans."""
    ship_package(docs.sparkSession)
    buckets = shuffle_width(docs)
    low_id = F.lit(-(2**63))
    keyed = docs.withColumn("__id", F.coalesce("doc_id", low_id)).withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = stored(keyed.select("__id", "__key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "text_ids")
    heads = ids.groupBy("__key").agg(F.min("__id").alias("head"))
    lows = repeated_minima(minima(docs, buckets)).groupBy("key").agg(F.collect_list("low").alias("__lows"))
    wanted = lows.join(heads, lows["key"] == heads["__key"]).select("__key", F.col("head").alias("__id"), "__lows")
    # One row for each text: rows of equal doc_id and text are one document here. All columns are kept
    # so that this join and the last one read the same shuffle of the texts.
    firsts = keyed.join(wanted, ["__id", "__key"]).dropDuplicates(["__id", "__key"])
    spans = segments(firsts, buckets).groupBy("bucket").applyInPandas(covered, "doc_id long, key long, start long, end long")
    per_text = spans.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.collect_list(F.struct("start", "end")).alias(SPANS)
    )
    whole = (F.col("__id") > F.col("head")) & (F.col("size") >= LENGTH)
    marks = (
        ids.distinct().join(heads, "__key").join(per_text, ["__id", "__key"], "left")
        .select("__id", "__key", whole.alias(WHOLE), SPANS).where(f"{WHOLE} OR {SPANS} IS NOT NULL")
    )
    return keyed.join(marks, ["__id", "__key"], "left").select(
        *docs.columns, F.coalesce(WHOLE, F.lit(False)).alias(WHOLE), SPANS
    )


def row_spans(size: int, whole: bool, spans) -> list[tuple[int, int]]:
    if whole:
        return [(0, size)]
    return merged([(s["start"], s["end"]) for s in spans]) if spans is not None else []


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""

    def run(batches):
        for b in batches:
            rows = []
            for text, whole, spans in zip(*(b.column(c).to_pylist() for c in ("text", WHOLE, SPANS)), strict=True):
                raw = (text or "").encode("utf-8")
                cut = row_spans(len(raw), whole, spans)
                rows.append((len(raw), sum(e - s for s, e in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest()))
            n, removed, count, sha = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return removals(docs.select("doc_id", "text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def whole_signs(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters that they cut."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append((s, e))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered text removed, whole characters only; n_chars follows; every row and other column stays."""
    marked = removals(docs)
    names = docs.columns

    def run(batches):
        for b in batches:
            texts, sizes = [], b.column("n_chars").to_pylist() if "n_chars" in names else []
            for i, (text, whole, spans) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", WHOLE, SPANS)), strict=True)):
                if text is not None and (whole or spans is not None):
                    raw = text.encode("utf-8")
                    text = kept_bytes(raw, whole_signs(raw, row_spans(len(raw), whole, spans))).decode("utf-8")
                    if sizes:
                        sizes[i] = len(text)
                texts.append(text)
            new = {"text": texts, "n_chars": sizes}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], b.column(c).type) if c in new else b.column(c) for c in names], names=names
            )

    return marked.mapInArrow(run, docs.schema)
