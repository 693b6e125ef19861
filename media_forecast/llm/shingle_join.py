"""Operator 7: Jaccard join of word shingles by vertical partitioning.

A document's set is its distinct 5-word shingles (64-bit hashes). Two documents
link when 100 * intersection >= 80 * union.

1. Documents with equal sets form one class; copies are never paired.
2. The order of all shingles is cut into fragments by hash range. A task sends
   each fragment its part of every distinct set once; the fragment finds the
   shingles that two or more classes have, and in how many. Only those go on.
3. A class whose set is not shared to at least 80 % can have no link and is
   done. The others are ordered by rising document frequency; two linked sets
   share a shingle among the first ``n - ceil(0.8 n) + 1`` of both (prefix
   filter; shingles of one class come first and so use the prefix up), and
   the place of the first common one bounds the overlap (position filter).
4. Candidates are verified by fragment: overlaps of the parts are counted
   separately and summed per pair.
5. Pairs are only wanted for components, so each list of a common prefix
   shingle is first compared with one pivot (two rounds, different pivots);
   then all remaining pairs of a list whose ends are in different components
   are compared. Nothing is dropped: a pair is left out only if its ends are
   already connected.

Null or blank text has an empty set (0 shingles), linked with nothing. Texts
with fewer than five words have one shingle, the whole sequence. Repeated rows
are copies. A null doc_id is never a component's name unless alone. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from media_forecast.llm.common import components, kept_by_worker, mix64, shuffle_width, stored
from media_forecast.shipping import ship_package

WORDS = 5
LEAST = 80  # percent
FLUSH = 1_500_000  # shingles that a task holds before it sends them to the fragments
SENT = 100_000  # shingles in one batch of rows for the fragments
KNOWN, KNOWN_LENGTH = 40_000, 32  # words whose hashes a worker remembers, and their bytes at most: a few MB
PARTS = 8  # fragments in verification
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """64-bit hash of each word; remembers the first short ones, among them the usual words of the texts."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN and len(word) <= KNOWN_LENGTH:
            self[word] = got
        return got


def shingles(text: str | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    found = (text or "").encode("utf-8").lower().split()  # ASCII letters and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = mix64(h * _SALT[j % len(_SALT)] + w[j: j + len(h)])
    return np.unique(h)


def set_key(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, key): size and identity of each document's set; key null if empty."""
    ship_package(docs.sparkSession)

    def run(batches):
        known = kept_by_worker("shingles", make=WordHashes)
        for b in batches:
            sets = [shingles(t, known, words) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_shingles": [len(h) for h in sets],
                "key": pd.array([set_key(h) if len(h) else None for h in sets], dtype="Int64"),
            })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, key long")


def fragments(docs: DataFrame, buckets: int, words: int = WORDS) -> DataFrame:
    """(bucket, h, owner, keys): the parts of the sets of many documents in one hash range, each distinct set once a flush."""

    def run(batches):
        known, sets, keys, held = kept_by_worker("shingles", make=WordHashes), [], {}, 0

        def flush():
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
            h, names = np.concatenate(sets), np.array(list(keys), np.int64)
            sets.clear()
            keys.clear()
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable").astype(np.int32)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows, size = [], 0
            for k in range(buckets):
                at = order[cuts[k]: cuts[k + 1]]
                if len(at):
                    own, local = np.unique(owner[at], return_inverse=True)
                    rows.append((k, h[at].tobytes(), local.astype("<i4").tobytes(), names[own].tobytes()))
                    size += len(at)
                # Sent in small batches: copies on the way to the JVM stay small.
                if rows and (size >= SENT or k == buckets - 1):
                    yield pd.DataFrame(rows, columns=["bucket", "h", "owner", "keys"])
                    rows, size = [], 0

        for b in batches:
            for t in b["text"]:
                s = shingles(t, known, words)
                if len(s) and (key := set_key(s)) not in keys:
                    keys[key] = None
                    sets.append(s)
                    held += len(s)
                    if held >= FLUSH:
                        yield from flush()
                        held = 0
        if sets:
            yield from flush()

    return docs.select("text").mapInPandas(run, "bucket int, h binary, owner binary, keys binary")


def shared_shingles(parts: DataFrame) -> DataFrame:
    """(key, h, df): every shingle of a class that at least one other class has, with its number of classes."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
        key = np.concatenate([
            np.frombuffer(k, np.int64)[np.frombuffer(o, "<i4")] for k, o in zip(pdf["keys"], pdf["owner"], strict=True)
        ])
        # First the shingles that occur twice at all: most are gone before the sort by class.
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        h, key = h[twice], key[twice]
        if not len(h):
            return pd.DataFrame({"key": [], "h": [], "df": []})
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, key = h[fresh], key[fresh]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.concatenate([starts, [len(h)]]))
        df = np.repeat(df, df)
        keep = df >= 2
        return pd.DataFrame({"key": key[keep], "h": h[keep].astype(np.int64), "df": df[keep]})

    return parts.groupBy("bucket").applyInPandas(count, "key long, h long, df long")


def need(n):
    """ceil(LEAST % of n)."""
    return F.floor((n * LEAST + 99) / 100).cast("long")


def least_overlap(na, nb):
    """Smallest overlap of linked sets: ceil(LEAST * (na + nb) / (100 + LEAST))."""
    return F.floor(((na + nb) * LEAST + 100 + LEAST - 1) / (100 + LEAST)).cast("long")


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The links among ``pairs(a, b)``: partial overlaps per fragment, summed per pair."""
    a = segments.select(F.col("key").alias("a"), "part", F.col("seg").alias("sa"), F.col("n").alias("na"))
    b = segments.select(F.col("key").alias("b"), "part", F.col("seg").alias("sb"), F.col("n").alias("nb"))
    partial = pairs.join(a, "a").join(b, ["b", "part"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o")
    )
    total = partial.groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * LEAST).select("a", "b")


def candidate(x: str, y: str):
    """Size and position filter of two entries of one prefix list."""
    c = lambda side, name: F.col(f"{side}.{name}")
    low, high = F.least(c(x, "n"), c(y, "n")), F.greatest(c(x, "n"), c(y, "n"))
    rest = 1 + F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    return (low * 100 >= high * LEAST) & (rest >= least_overlap(c(x, "n"), c(y, "n")))


def ordered(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(alive: DataFrame) -> DataFrame:
    """Links(a, b) between classes that connect every component of ``alive(key, n, items)``."""
    spark = alive.sparkSession
    prefix = F.slice("items", 1, (F.size("items") - need(F.col("n")) + 1).cast("int"))
    index = stored(
        alive.select("key", "n", "central", F.size("items").alias("r"), F.posexplode(prefix).alias("at", "item")).select(
            F.col("item.h").alias("h"), "key", "n", "central", (F.col("n") - F.col("r") + F.col("at") + 1).alias("pos")
        ), "prefixes",
    )
    part = F.shiftrightunsigned(F.col("item.h"), 64 - (PARTS.bit_length() - 1)).cast("int")
    segments = stored(
        alive.select("key", "n", F.explode("items").alias("item")).groupBy("key", "n", part.alias("part")).agg(
            F.collect_list("item.h").alias("seg")
        ), "segments",
    )
    empty = spark.createDataFrame([], "a long, b long")
    found, tried, comp = empty, empty, spark.createDataFrame([], "node long, comp long")
    placed = index.withColumn("comp", F.col("key"))
    for step, best in enumerate((F.struct("central", "key"), F.struct(F.xxhash64("key"), "key"), None)):
        if step:
            placed = index.join(comp, index["key"] == comp["node"], "left").select(
                "h", "key", "n", "central", "pos", F.coalesce("comp", "key").alias("comp")
            )
        open_lists = placed.groupBy("h").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            *([F.max_by(F.struct("key", "n", "pos", "comp"), best).alias("pivot")] if best is not None else []),
        ).where("lo <> hi")
        if best is not None:
            x = open_lists.select("h", "pivot.*").alias("x")
            pairs = placed.alias("y").join(x, "h").where((F.col("x.comp") != F.col("y.comp")) & candidate("x", "y"))
        else:
            rest = placed.join(open_lists.select("h"), "h")
            x, y = rest.alias("x"), rest.alias("y")
            pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") < F.col("y.comp")) & candidate("x", "y"))
        pairs = pairs.select(*ordered(F.col("x.key"), F.col("y.key"))).distinct()
        if step:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            if best is None:
                break
            continue
        found = stored(found.unionAll(verified(pairs, segments)), "links")
        tried = tried.unionAll(pairs)
        if best is not None:
            comp = components(found)
    return found


def components_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    signed = stored(signatures(docs, words), "sets")
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    shared = shared_shingles(fragments(docs, shuffle_width(docs), words))
    lists = shared.groupBy("key").agg(
        F.collect_list(F.struct("df", "h")).alias("items"), F.sum("df").alias("weight")
    )
    # Joined by key rather than kept in the lists: the sizes are those of whole sets.
    alive = stored(
        lists.join(classes.select("key", "n"), "key").where(F.size("items") >= need(F.col("n")))
        .select("key", "n", (F.col("weight") / F.col("n")).alias("central"), F.array_sort("items").alias("items")),
        "alive",
    )
    comp = components(links(alive))
    named = comp.join(classes, comp["node"] == classes["key"]).groupBy("comp").agg(F.min("rep").alias("component"))
    of_key = comp.join(named, "comp").select(F.col("node").alias("key"), "component")
    of_class = classes.join(of_key, "key", "left").select("key", F.coalesce("component", "rep").alias("component"))
    return signed.join(of_class, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id.

    Rows that share a doc_id are one document: they stay or go together, equal texts once. Null doc_ids stay.
    """
    found = stored(components_of(docs, words), "components")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1")
    left = docs.join(gone, "doc_id", "left_anti").join(again, "doc_id", "left")
    once = left.where("__rows IS NULL").unionAll(left.where("__rows IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    return once.select(*docs.columns)
