"""Operator 1: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fit (on a bounded sample of labelled rows, ``SAMPLE`` rows by hash of doc_id):
- Terms are words, word beginnings of 4 to 6 signs, and beginnings that two,
  or three, different words of the text share. A term is kept if examples tie
  it to the toxic label: by its exact hypergeometric tail, at a false
  discovery rate of ``FALSE_TERMS`` over all terms that could reach that tail
  at all, and ``MIN_LIFT`` times as frequent in toxic examples. So the test
  follows the size of the sample. Near copies among the examples count once
  for this (equal minimum hashes of their words). At most ``MAX_TERMS`` terms,
  the smallest tails first.
- Document frequencies of the kept terms are counted over the whole corpus.
- The index holds the examples of both labels that have a kept term, as
  inverted lists by term with, for every block of ``BLOCK`` examples, the
  largest weight.

Search: for each document the block maxima bound the cosine of any example of
a block; blocks are visited by falling bound until no bound reaches the k-th
best. That is exact: the same neighbours as comparing with every example.

Score: votes of the k nearest weighted by 1 / (distance + 0.1), smoothed by
the share of toxic examples among those without any kept term (smoothed by one
example of the sample's share); a text with no kept term, empty texts too, has
that share as its score.

Null text counts as empty. Labels that are null, and rows of labels without a
document, are not used; of several labels of one document the smallest counts.
Without usable labels, or toxic ones among them, every score is 0; if all are
toxic, every score is 1. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from media_forecast.llm.common import kept_by_worker
from media_forecast.shipping import ship_package

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
SAMPLE = 8000  # labelled rows that the fit uses at most
MAX_TERMS = 4096
FALSE_TERMS, MIN_LIFT = 0.1, 6.0
SHARED_BY = (2, 3)  # different words of a text that make their common beginning a term of its own
BLOCK, NEAREST = 64, 15
FEW_BLOCKS = 4  # blocks visited one by one before a search reads whole lists
PRIOR_WEIGHT = 0.5
HELD_OUT_OF = 5
KNOWN_WORDS, KNOWN_COUNTS = 40_000, 5_000  # words, and scored sets of terms, that a worker remembers


def terms_of(word: str) -> list[str]:
    return ["=" + word] + [word[:n] + "*" for n in STEMS if len(word) >= n]


def features(words) -> set[str]:
    """All terms of a text's different words."""
    found: set[str] = set()
    starts: Counter = Counter()
    for w in words:
        terms = terms_of(w)
        found.update(terms)
        starts.update(terms[1:])
    found.update(f"{t}{n}" for t, c in starts.items() for n in SHARED_BY if c >= n)
    return found


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, y): at most ``sample`` labelled rows that are not held out."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # Bounded by ``sample`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def tied_to_label(pairs: dict[tuple[int, int], int], pos: int, neg: int) -> dict[tuple[int, int], float]:
    """The counts (toxic, other examples with a term) that are kept, with their tails.

    ``pairs`` says how many terms have these counts. The tail of (a, b) is the
    chance that a + b of all examples, drawn at random, hold a toxic ones or
    more. The largest tail p is taken for which the terms that can reach p,
    times p, are at most ``FALSE_TERMS`` of the terms at p or below.
    """
    n = pos + neg
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])

    def choose(m, k):
        return log_fact[m] - log_fact[k] - log_fact[m - k]

    def tail(a, size):
        x = np.arange(a, min(size, pos) + 1)
        x = x[size - x <= neg]
        return float(np.exp(choose(pos, x) + choose(neg, size - x) - choose(n, size)).sum())

    reach: Counter = Counter()  # least tail that terms of this many examples can have -> terms
    least: dict[int, float] = {}
    tails: dict[tuple[int, int], float] = {}
    for (a, b), terms in pairs.items():
        size = a + b
        if size not in least:
            least[size] = tail(min(size, pos), size)
        reach[least[size]] += terms
        if a * neg > b * pos:
            tails[a, b] = tail(a, size)
    floors = sorted(reach)
    upto = np.cumsum([reach[p] for p in floors])
    limit, below = 0.0, 0
    for p, terms in sorted((p, pairs[ab]) for ab, p in tails.items()):
        below += terms
        could = upto[bisect_right(floors, p * (1 + 1e-9)) - 1]
        if p * could <= FALSE_TERMS * below:
            limit = p
    return {
        (a, b): p for (a, b), p in tails.items()
        if p <= limit and (a + 0.5) / (pos + 1) >= MIN_LIFT * (b + 0.5) / (neg + 1)
    }


def pick_terms(sample: DataFrame) -> list[str]:
    """The terms tied to the label, strongest first."""

    def sketch(batches):
        for b in batches:
            rows = []
            for d, t, y in zip(b["doc_id"], b["text"], b["y"], strict=True):
                words = set(WORD.findall((t or "").lower()))
                rare = [w for w in words if len(w) > 5] or words
                mins = [min((xxhash.xxh64_intdigest(w, seed) >> 1 for w in rare), default=-d - 1) for seed in (1, 2, 3)]
                rows.append((d, y, *mins, sorted(features(words))))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "m1", "m2", "m3", "terms"])

    examples = sample.mapInPandas(sketch, "doc_id long, y int, m1 long, m2 long, m3 long, terms array<string>")
    for m in ("m1", "m2", "m3"):
        examples = examples.dropDuplicates([m, "y"])
    examples = examples.persist()
    try:
        total = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
        pos, neg = total.get(1, 0), sum(n for y, n in total.items() if y != 1)
        if not pos or not neg:
            return []
        counts = examples.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(
            F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("b")
        )
        # The sample bounds the pairs (a, b), and most terms share a few of them.
        pairs = {(r["a"], r["b"]): r["n"] for r in counts.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
        tails = tied_to_label(pairs, pos, neg)
        if not tails:
            return []
        kept = counts.sparkSession.createDataFrame([(*ab, p) for ab, p in tails.items()], "a long, b long, p double")
        best = counts.join(F.broadcast(kept), ["a", "b"]).orderBy("p", "term").limit(MAX_TERMS)
        return [r["term"] for r in best.select("term").collect()]
    finally:
        examples.unpersist()


class Terms:
    """Counts the kept terms of a text; a shared beginning counts once."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        starts = sorted({t[:-1] for t in terms if t[0] != "=" and t[-1] != "*"})
        self.start_at = {t: -1 - i for i, t in enumerate(starts)}
        self.shared = [[(n, self.at[f"{t}{n}"]) for n in SHARED_BY if f"{t}{n}" in self.at] for t in starts]
        self.known: dict[str, tuple] = {}

    def _places(self, word: str) -> tuple:
        """Numbers of the word's kept terms, and below 0 those of its beginnings that may be shared."""
        terms = terms_of(word)
        return (*[self.at[t] for t in terms if t in self.at], *[self.start_at[t] for t in terms[1:] if t in self.start_at])

    def counts(self, text: str | None) -> dict[int, int]:
        got: dict[int, int] = {}
        starts: dict[int, int] = {}
        known = self.known
        for w, c in Counter(WORD.findall((text or "").lower())).items():
            hit = known.get(w)
            if hit is None:
                hit = self._places(w)
                if len(known) < KNOWN_WORDS and len(w) <= 32:
                    known[w] = hit
            for i in hit:
                if i >= 0:
                    got[i] = got.get(i, 0) + c
                else:
                    starts[i] = starts.get(i, 0) + 1
        for i, words in starts.items():
            for n, at in self.shared[-1 - i]:
                if words >= n:
                    got[at] = 1
        return got


def corpus_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[int, int]]:
    """Number of documents, and for each kept term the number that have it; counted over all rows."""

    def run(batches):
        kept_by_worker("toxicity")
        find, seen, n = Terms(terms), Counter(), 0
        for b in batches:
            n += len(b)
            for t in b["text"]:
                seen.update(find.counts(t).keys())
        yield pd.DataFrame([(-1, n), *seen.items()], columns=["term", "n"])

    rows = docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    got = {r["term"]: r["n"] for r in rows}
    return got.pop(-1, 0), got


def weights(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    """Unit vector of (1 + log tf) * idf."""
    raw = {i: (1 + math.log(c)) * idf[i] for i, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {i: raw[i] / norm for i in sorted(raw)} if norm else {}


class BlockMaxIndex:
    """Inverted lists over examples in blocks, with the largest weight of each term and block."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int = BLOCK):
        self.block, self.n = block, len(vectors)
        blocks = -(-self.n // block) if self.n else 0
        self.lists: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(n_terms)]
        self.bound = np.zeros((n_terms, blocks))
        for e, vector in enumerate(vectors):
            for i, x in vector.items():
                self.lists[i].setdefault(e // block, []).append((e, x))
                self.bound[i, e // block] = max(self.bound[i, e // block], x)
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # lists that long searches have read in one piece

    def _list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """All of a term's list: examples and weights."""
        if i not in self.whole:
            pairs = [p for found in self.lists[i].values() for p in found]
            self.whole[i] = np.array([e for e, _ in pairs], np.int64), np.array([x for _, x in pairs], float)
        return self.whole[i]

    def _nearest_of_all(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        sums = np.zeros(self.n)
        for i, x in query.items():
            at, weight = self._list(i)
            sums[at] += x * weight
        at = np.flatnonzero(sums)
        cosine = np.round(sums[at], 12)
        if len(at) > k:
            # All that reach the k-th best cosine, so that ties are settled by the example.
            some = cosine >= np.partition(cosine, len(at) - k)[len(at) - k]
            at, cosine = at[some], cosine[some]
        order = np.lexsort((at, -cosine))[:k]
        return list(zip(cosine[order].tolist(), at[order].tolist(), strict=True))

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k best (cosine, example), falling cosine, ties to the smaller example; only examples that share a term."""
        if not query or not self.n:
            return []
        terms = list(query)
        bounds = np.array([query[i] for i in terms]) @ self.bound[terms]
        top: list[tuple[float, int]] = []  # heap of (cosine, -example)
        for visits, at in enumerate(np.argsort(-bounds, kind="stable")):
            reach = bounds[at] + 1e-9  # the sums below may round otherwise than the bound
            if bounds[at] <= 0 or len(top) == k and reach < top[0][0]:
                break
            if visits == FEW_BLOCKS:
                # The bounds do not settle it soon: the same sums, list by list over all blocks, cost less.
                return self._nearest_of_all(query, k)
            sums: dict[int, float] = {}
            for i in terms:
                for e, x in self.lists[i].get(int(at), ()):
                    sums[e] = sums.get(e, 0.0) + query[i] * x
            for e, s in sums.items():
                item = (round(s, 12), -e)
                if len(top) < k:
                    heapq.heappush(top, item)
                elif item > top[0]:
                    heapq.heapreplace(top, item)
        return [(s, -e) for s, e in sorted(top, reverse=True)]


class Model:
    def __init__(self, terms, idf, examples, prior, nearest=NEAREST):
        self.terms, self.idf, self.prior, self.k = terms, idf, prior, nearest
        self.ids, self.y = [e[0] for e in examples], [e[1] for e in examples]
        self.index = BlockMaxIndex([weights(e[2], idf) for e in examples], len(terms))

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        """(score, doc_ids of the neighbours, nearest first)."""
        up, down, evidence = PRIOR_WEIGHT * self.prior, PRIOR_WEIGHT, []
        for cosine, e in self.index.nearest(weights(counts, self.idf), self.k):
            w = 1 / (1 - min(1.0, cosine) + 0.1)
            up, down = up + w * self.y[e], down + w
            evidence.append(self.ids[e])
        return up / down, evidence


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """(terms, idf, examples, prior): all bounded by ``sample`` rows and ``MAX_TERMS`` terms."""
    ship_package(docs.sparkSession)
    rows = sample_of(docs, labels, sample)
    terms = pick_terms(rows)
    n, df = corpus_frequencies(docs, terms) if terms else (0, {})
    idf = np.array([math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])

    def vectors(batches):
        find = Terms(terms)
        for b in batches:
            got = [find.counts(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "y": b["y"],
                "at": [list(c) for c in got], "tf": [list(c.values()) for c in got],
            })

    found = rows.mapInPandas(vectors, "doc_id long, y int, at array<int>, tf array<int>").collect()
    examples = sorted((r["doc_id"], int(r["y"] == 1), dict(zip(r["at"], r["tf"], strict=True))) for r in found if r["at"])
    blank = [int(r["y"] == 1) for r in found if not r["at"]]
    share = sum(int(r["y"] == 1) for r in found) / len(found) if found else 0.0
    return terms, idf, examples, (sum(blank) + share) / (len(blank) + 1)


SCORE, EVIDENCE = "__toxicity_score", "__toxicity_evidence"


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with its score and evidence (doc_ids of the nearest examples) as columns SCORE and EVIDENCE; all columns stay."""
    model_parts = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        kept_by_worker("toxicity")
        model = Model(*model_parts.value)
        find, memo = Terms(model.terms), {}
        for b in batches:
            got = []
            for t in b.column("text").to_pylist():
                counts = find.counts(t)
                key = tuple(sorted(counts.items()))
                if key not in memo:
                    if len(memo) >= KNOWN_COUNTS:
                        memo.clear()
                    memo[key] = model.score(counts)
                got.append(memo[key])
            b = b.append_column(SCORE, pa.array([g[0] for g in got], pa.float64()))
            yield b.append_column(EVIDENCE, pa.array([g[1] for g in got], pa.list_(pa.int64())))

    schema = StructType([*docs.schema.fields, StructField(SCORE, DoubleType()), StructField(EVIDENCE, ArrayType(LongType()))])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of each document."""
    return scores(docs.select("doc_id", "text"), labels, sample).select(
        "doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"),
        (F.col(SCORE) >= 0.5).cast("int").alias("predicted"), F.col(EVIDENCE).alias("evidence"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5."""
    return scores(docs, labels, sample).where(F.col(SCORE) < 0.5).select(*docs.columns)
