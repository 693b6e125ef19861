"""Operator 13: benchmark decontamination by a distributed positional inverted index.

Words are runs of digits, lower-cased letters and signs outside ASCII.

1. ``build_index`` turns documents into blocks of about ``BLOCK_BYTES`` of text,
   each with its own inverted index: every word of the block's documents, and
   per word the ascending places where it stands. Places count through the
   block, with one free place after each document, so that a phrase never
   crosses documents. The blocks are written as Parquet, one row each; all
   words are kept, so one index answers any test set.
2. Test items are cut into windows of ``WINDOW`` consecutive words (an item of
   fewer, but at least one, is one window). They go to the tasks in blocks of
   at most ``ITEM_BYTES`` of words; more items mean more passes, not larger
   broadcasts. Items longer than that are cut into pieces that overlap by
   ``WINDOW - 1`` words, which keeps all windows.
3. For each block and window the lists are intersected from the window's rarest
   word in the block on: a list minus the word's offset gives the places where
   the window may begin. The first two lists of neighbouring windows are mostly
   the same, so their intersection is kept for the block.
4. Proximity (``within``): stretches of at most that many words which hold every
   distinct word of the window, in any order, and no shorter such stretch. The
   places of the rarest word bound where they can lie.

Every document is in exactly one block and a hot word is split over all blocks,
so no list grows with the corpus. Null or empty texts have no words. Repeated
rows give repeated rows, a null doc_id is kept. Items with equal windows all
count; a null item_id marks words but names no item; repeated items count once.
Extra columns are ignored. Without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from media_forecast.llm.common import stored
from media_forecast.shipping import ship_package

WINDOW = 10
BLOCK_BYTES = 4 << 20  # text in one block of the index; a longer document is a block by itself
ITEM_BYTES = 4 << 20  # words of test items that go to the tasks at once

# Bytes of words as they are (ASCII letters small), everything else a space. All bytes above 0x7F are parts of words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
INDEX = "block string, ids array<long>, lengths array<int>, terms binary, counts binary, places binary"
FOUND = "block string, at int, doc_id long, n_words int, items array<long>, starts array<int>, ends array<int>"
NEAR = ", near_items array<long>, near_starts array<int>, near_ends array<int>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Numbering(dict):
    """A number for each word in the order of arrival."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


class BlockBuilder:
    """Collects documents and packs their positional index."""

    def __init__(self):
        self.number, self.words, self.ids, self.lengths, self.bytes = Numbering(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = words_of(text)
        self.words.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.bytes += len(text or b"") + 64  # the rows of empty texts have a size too

    def pack(self, block: str) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        words = np.concatenate(self.words)
        places = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)  # one free place per document
        order = np.argsort(words, kind="stable")
        counts = np.bincount(words, minlength=len(self.number)).astype("<i4")
        # Stored as differences: small numbers, which compress well.
        steps = np.diff(places[order], prepend=0).astype("<i4")
        return pa.RecordBatch.from_arrays([
            pa.array([block]), pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.lengths], pa.list_(pa.int32())),
            pa.array([b" ".join(self.number)], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([steps.tobytes()], pa.binary()),
        ], ["block", "ids", "lengths", "terms", "counts", "places"])


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The positional index of ``docs(doc_id, text)``, one row per block of documents; written to the shared folder."""
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, building = TaskContext.get().partitionId(), 0, BlockBuilder()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                building.add(doc_id, text.as_py())
                if building.bytes >= block_bytes:
                    yield building.pack(f"{task}-{done}")
                    done, building = done + 1, BlockBuilder()
        if building.ids:
            yield building.pack(f"{task}-{done}")

    # Stored, so that a block keeps its name in every pass over the index.
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX), "positions")


def item_pieces(items: DataFrame, window: int, limit: int) -> Iterator[tuple[int | None, list[bytes]]]:
    """(item_id, words) in pieces of about ``limit`` bytes at most; pieces of one item overlap by ``window - 1`` words."""
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).toLocalIterator():
        words, start, size = words_of(row[1] and bytes(row[1])), 0, 0
        for k, word in enumerate(words):
            size += len(word) + 1
            if size >= limit and k - start + 1 > window:
                yield row[0], words[start: k + 1]
                start, size = k + 2 - window, sum(len(w) + 1 for w in words[k + 2 - window: k + 1])
        if len(words) - start >= window or start == 0 and words:
            yield row[0], words[start:]


class Windows:
    """The distinct windows of a bounded set of items, with the items that have each."""

    def __init__(self, pieces: Iterable[tuple[int | None, list[bytes]]], window: int):
        self.terms: dict[bytes, int] = Numbering()
        self.owners: dict[tuple[int, ...], set] = {}
        for item, words in pieces:
            numbers = [self.terms[w] for w in words]
            for k in range(max(1, len(numbers) - window + 1)):
                self.owners.setdefault(tuple(numbers[k: k + window]), set()).add(item)

    def __len__(self) -> int:
        return len(self.owners)


def item_blocks(items: DataFrame, window: int, limit: int) -> Iterator[Windows]:
    """Windows of all items in blocks of about ``limit`` bytes of words, at least one block."""
    held, size, any_block = [], 0, False
    for item, words in item_pieces(items, window, limit):
        held.append((item, words))
        size += sum(len(w) + 1 for w in words)
        if size >= limit:
            yield Windows(held, window)
            held, size, any_block = [], 0, True
    if held or not any_block:
        yield Windows(held, window)


class Postings:
    """The places of the test words in one block of the index."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes, wanted: dict[bytes, int]):
        n = np.frombuffer(counts, "<i4")
        ends = np.cumsum(n, dtype=np.int64)
        at = np.cumsum(np.frombuffer(places, "<i4"), dtype=np.int64)
        self.lists: dict[int, np.ndarray] = {}
        for k, word in enumerate(terms.split(b" ") if terms else ()):
            number = wanted.get(word)
            if number is not None:
                self.lists[number] = at[ends[k] - n[k]: ends[k]]
        self.size = {number: len(p) for number, p in self.lists.items()}
        self.pairs: dict[tuple[int, int, int], np.ndarray] = {}

    def keep(self, starts: np.ndarray, number: int, offset: int) -> np.ndarray:
        """Those of ``starts`` that have the word ``number`` at ``offset`` places behind them."""
        at = self.lists[number]
        k = np.searchsorted(at, starts + offset)
        return starts[at[np.minimum(k, len(at) - 1)] == starts + offset]

    def rarest_first(self, window: tuple[int, ...]) -> list[int] | None:
        """Offsets into the window by the length of the word's list; None if the block lacks a word."""
        size = self.size
        try:
            return sorted(range(len(window)), key=[size[t] for t in window].__getitem__)
        except KeyError:
            return None

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """The places where the window begins."""
        order = self.rarest_first(window)
        if order is None:
            return np.empty(0, np.int64)
        a = order[0]
        if len(order) == 1:
            return self.lists[window[a]] - a
        b = order[1]
        key = (window[a], window[b], b - a)
        both = self.pairs.get(key)
        if both is None:
            both = self.pairs[key] = self.keep(self.lists[window[a]], window[b], b - a)
        starts = both - a
        for offset in order[2:]:
            if not len(starts):
                break
            starts = self.keep(starts, window[offset], offset)
        return starts

    def near(self, window: tuple[int, ...], within: int, doc_of: np.ndarray) -> set[tuple[int, int]]:
        """Shortest stretches (first, last place) of at most ``within`` words that hold all words of the window."""
        distinct = tuple(dict.fromkeys(window))
        order = self.rarest_first(distinct)
        if order is None:
            return set()
        anchors = self.lists[distinct[order[0]]]
        for k in order[1:]:
            at = self.lists[distinct[k]]
            lo = np.searchsorted(at, anchors - within + 1)
            anchors = anchors[(lo < len(at)) & (at[np.minimum(lo, len(at) - 1)] <= anchors + within - 1)]
        found: set[tuple[int, int]] = set()
        for anchor in anchors.tolist():
            here = []
            for t in distinct:
                at = self.lists[t]
                lo, hi = np.searchsorted(at, (anchor - within + 1, anchor + within))
                here += [(p, t) for p in at[lo:hi].tolist() if doc_of[p] == doc_of[anchor]]
            here.sort()
            last: dict[int, int] = {}
            best_start = -1
            for p, t in here:
                last[t] = p
                if len(last) == len(distinct):
                    start = min(last.values())
                    # A stretch is a shortest one if the last place gave it a later beginning than any before.
                    if p - start < within and start > best_start:
                        found.add((start, p))
                    best_start = max(best_start, start)
        return {(s, e) for s, e in found if not any(s <= s2 and e2 <= e and (s2, e2) != (s, e) for s2, e2 in found if s <= s2 <= e)}


def runs(starts: list[int], width: int) -> list[tuple[int, int]]:
    """Merged stretches [from, to) of windows of one width."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + width))
        else:
            out.append((s, s + width))
    return out


def search_block(row: dict, tests: Windows, within: int | None) -> pa.RecordBatch:
    """One row per document of an index block: what of the tests stands where in it."""
    lengths = np.array(row["lengths"], np.int64)
    n = len(lengths)
    begins = np.cumsum(lengths + 1) - lengths - 1
    postings = Postings(row["terms"], row["counts"], row["places"], tests.terms)
    phrase: list[dict] = [{} for _ in range(n)]  # per document: item -> widths -> starts
    near: list[set] = [set() for _ in range(n)]
    doc_of = np.repeat(np.arange(n), lengths + 1) if within is not None else None
    for window, owners in tests.owners.items():
        starts = postings.phrase(window)
        if len(starts):
            docs = np.searchsorted(begins, starts, "right") - 1
            for d, s in zip(docs.tolist(), (starts - begins[docs]).tolist(), strict=True):
                for item in owners:
                    phrase[d].setdefault((item, len(window)), []).append(s)
        if within is not None:
            for first, last in postings.near(window, within, doc_of):
                d = int(doc_of[first])
                near[d].update((item, first - int(begins[d]), last + 1 - int(begins[d])) for item in owners)

    def null_first(span):
        return (span[0] is not None, *((x or 0) for x in span))

    spans = []
    for found in phrase:
        by_item: dict = {}
        for (item, width), starts in found.items():
            by_item.setdefault(item, []).extend(runs(starts, width))
        spans.append(sorted(((item, s, e) for item, rows in by_item.items() for s, e in rows), key=null_first))
    columns = [
        pa.array([row["block"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(lengths, pa.int32()),
    ]
    names = ["block", "at", "doc_id", "n_words"]
    for prefix, found in (("", spans), *([("near_", [sorted(s, key=null_first) for s in near])] if within is not None else [])):
        for k, name, kind in ((0, "items", pa.int64()), (1, "starts", pa.int32()), (2, "ends", pa.int32())):
            columns.append(pa.array([[s[k] for s in doc] for doc in found], pa.list_(kind)))
            names.append(prefix + name)
    return pa.RecordBatch.from_arrays(columns, names)


def spans_of(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, spans[, near]) of each document of the index.

    ``spans`` are (item_id, start, end): the words of the document, end
    exclusive, that windows of the item cover; ``near`` likewise for stretches
    of at most ``within`` words that hold all words of one of its windows.
    """
    sc = index.sparkSession.sparkContext
    schema = FOUND + (NEAR if within is not None else "")
    passes = []
    for tests in item_blocks(items, window, item_bytes):
        shared = sc.broadcast(tests)  # bounded by item_bytes

        def run(batches, shared=shared):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield search_block(batch.slice(k, 1).to_pylist()[0], shared.value, within)

        passes.append(index.mapInArrow(run, schema))
    lists = [("spans", ""), *([("near", "near_")] if within is not None else [])]
    found = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionAll(more)
        names = [p + c for _, p in lists for c in ("items", "starts", "ends")]
        found = found.groupBy("block", "at").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.collect_list(F.struct(*names)).alias("parts"),
        ).select("doc_id", "n_words", *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in names])

    def zipped(name, p):
        rows = F.arrays_zip(F.col(p + "items").alias("item_id"), F.col(p + "starts").alias("start"), F.col(p + "ends").alias("end"))
        return rows.cast("array<struct<item_id:long,start:int,end:int>>").alias(name)

    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *[zipped(*x) for x in lists])


def covered(spans) -> F.Column:
    """Number of words that at least one of the spans covers."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    return F.aggregate(by_start, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["until"], s["start"]))).alias("n"),
        F.greatest(acc["until"], s["end"]).alias("until"),
    ), lambda acc: acc["n"].cast("long"))


def digests(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = spans_of(build_index(docs), items, window)
    named = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["item_id"].cast("string")), lambda x: x.isNotNull())))
    hit = found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), named.alias("named"))
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("named").cast("long").alias("n_items"),
        F.sha2(F.array_join("named", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# The same result as SQL: all windows of documents and items, joined by their words.
_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(text='text')}, []::VARCHAR[]) AS w FROM documents
),
b AS (SELECT item_id, {_WORDS.format(text='text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[k:least(k + {WINDOW - 1}, len(w))], ' ') AS phrase, least({WINDOW}, len(w)) AS width
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS k FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT r, k, width, array_to_string(w[k:k + width - 1], ' ') AS phrase
  FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, (SELECT DISTINCT width FROM bw) WHERE len(w) >= width)
),
hits AS (SELECT r, k, dw.width, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.width = bw.width),
n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + width)) AS p FROM hits) GROUP BY r
),
i AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
