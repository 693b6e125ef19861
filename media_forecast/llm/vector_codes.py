"""Operator 12: compression of vectors to codes of four parts, entries found by Orchard's search.

A component x becomes the integer floor(``SCALE`` * x); vectors are cut into
``PARTS`` equal consecutive parts. Each part's codebook starts as that part of
the ``ENTRIES`` smallest vec_ids and is refined ``ROUNDS`` times: every part goes
to its nearest entry (squared Euclidean distance, ties to the lower index), then
an entry becomes the floor of the mean of its parts; unused entries stay.

Nearest entries by Orchard's search: every entry has the list of all entries by
rising distance from it. A search walks the list of its best entry so far, marks
what it has compared, jumps to the list of an entry that is nearer, and stops
where the list goes beyond twice the current distance: by the triangle
inequality no later entry can be as near. All distances are squared integers, so
ties are exact ("beyond twice" is more than four times the square).

A round is one pass over the stored integer vectors: tasks sum the parts of each
entry, Spark adds up those sums, and the driver holds the codebooks alone,
``PARTS * ENTRIES`` entries at most, however many vectors there are.

Vectors that are null or hold null or non-finite components are left out. A
length that four does not divide is filled up with zeros. A vector of another
length than that of the smallest vec_id, or with a component too large for exact
64-bit distances, takes no part and has null code and error. Repeated rows count
each; equal vec_ids are ordered by their vectors, null vec_ids come last. Fewer
rows than entries give as many entries as rows. An empty table gives no rows.
Null labels form one group. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from media_forecast.llm.common import stored
from media_forecast.shipping import ship_package

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4


def largest_component(width: int) -> int:
    """Integers up to this size keep four times a squared distance of ``width`` components within 64 bits."""
    return min(2**31 - 1, isqrt(2**63 // (16 * max(1, width))) - 1)


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


class Codebook:
    """Entries of one part with their neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squares(entries[:, None, :] - entries[None, :, :])
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of every row of ``x``; all rows take a step of their own walk at once."""
        n, k = len(x), len(self.entries)
        best = np.zeros(n, np.int64)
        d = squares(x - self.entries[0])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)  # place in the list of the best entry
        walking = np.arange(n)
        while len(walking):
            b, p = best[walking], at[walking]
            on = (p < k) & (self.apart[b, np.minimum(p, k - 1)] <= 4 * d[walking])
            walking, b, p = walking[on], b[on], p[on]
            entry = self.near[b, p]
            at[walking] = p + 1
            fresh = ~seen[walking, entry]
            rows, entry = walking[fresh], entry[fresh]
            seen[rows, entry] = True
            e = squares(x[rows] - self.entries[entry])
            nearer = (e < d[rows]) | (e == d[rows]) & (entry < best[rows])
            rows = rows[nearer]
            best[rows], d[rows], at[rows] = entry[nearer], e[nearer], 0
        return best, d


def integers(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, label, x): rows that are kept, components as integers."""
    v = F.col(column)
    finite = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(finite).select("vec_id", "label", x.alias("x"))


def matrix(batch: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their vectors with width filled up)."""
    lists = batch.column(column)
    taking = np.asarray(lists.is_valid())
    x = lists.filter(pa.array(taking)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(int(taking.sum()), dim)
    return taking, np.pad(x, ((0, 0), (0, -dim % PARTS)))


def cut(x: np.ndarray) -> list[np.ndarray]:
    width = x.shape[1] // PARTS
    return [x[:, p * width: (p + 1) * width] for p in range(PARTS)]


def refined(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round over ``rows(x)``."""
    width = books[0].shape[1]
    names = [f"s{j}" for j in range(width)]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        found = [Codebook(b) for b in shared.value]
        total = [np.zeros((len(b), width + 1), np.int64) for b in shared.value]
        for batch in batches:
            for part, (book, x) in enumerate(zip(found, cut(matrix(batch, "x", dim)[1]), strict=True)):
                entry, _ = book.search(x)
                np.add.at(total[part], entry, np.pad(x, ((0, 0), (1, 0)), constant_values=1))
        for part, sums in enumerate(total):
            used = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part), pa.int32()), pa.array(used, pa.int32()), *(pa.array(c) for c in sums[used].T)],
                ["part", "entry", "n", *names],
            )

    sums = rows.select("x").mapInArrow(run, "part int, entry int, n long" + "".join(f", {s} long" for s in names))
    # At most PARTS * ENTRIES rows, added up before the shuffle.
    added = sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect()
    books = [b.copy() for b in books]
    for r in added:
        books[r["part"]][r["entry"]] = [r[s] // r["n"] for s in names]
    return books


def fit(rows: DataFrame, dim: int) -> list[np.ndarray]:
    """The codebooks of ``rows(vec_id, x)``, one per part."""
    first = rows.where("x IS NOT NULL").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    books = cut(np.pad(np.array([r["x"] for r in first], np.int64).reshape(len(first), dim), ((0, 0), (0, -dim % PARTS))))
    for _ in range(ROUNDS):
        books = refined(rows, books, dim)
    return books


def encode(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(vec_id, label, code, error) of every row; ``code`` has two hex digits per part."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        found = [Codebook(b) for b in shared.value]
        for batch in batches:
            taking, x = matrix(batch, "x", dim)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for part, (book, v) in enumerate(zip(found, cut(x), strict=True)):
                code[:, part], d = book.search(v)
                error += d
            where = np.cumsum(taking) - 1
            codes = [code[k].tobytes().hex() if on else None for k, on in zip(where, taking, strict=True)]
            errors = [int(error[k]) if on else None for k, on in zip(where, taking, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long")


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for row in b for c in row).encode()).hexdigest()


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that is kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = integers(vectors, column)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    dim = first[0] if first else 0
    most = largest_component(-(-dim // PARTS))
    fits = (F.size("x") == dim) & F.forall("x", lambda c: c.between(-most, most))
    rows = stored(rows.withColumn("x", F.when(fits, F.col("x").cast("array<int>"))), "integers")
    books = fit(rows, dim) if first and rows.where("x IS NOT NULL").take(1) else [np.zeros((1, -(-dim // PARTS)), np.int64)] * PARTS
    coded = stored(encode(rows, books, dim), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")
    )


def sql() -> str:
    """The same result as SQL, every part compared with every entry (vectors of one length that four divides)."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
a{k} AS (SELECT r, p, min(row(d, e)) AS best FROM (
  SELECT t.r, t.p, c.e, CAST(t.vv - 2 * list_inner_product(t.v, c.v) + c.vv AS BIGINT) AS d FROM t JOIN c{k} c ON t.p = c.p) GROUP BY r, p)""")
        if k < ROUNDS:
            rounds.append(f"""
m{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS v FROM (
    SELECT a.p, a.best[2] AS e, i, sum(t.v[i]) AS s, count(*) AS n
    FROM a{k} a JOIN t ON a.r = t.r AND a.p = t.p, (SELECT unnest(range(1, (SELECT len(v) FROM t LIMIT 1) + 1)) AS i)
    GROUP BY ALL) GROUP BY p, e),
c{k + 1} AS (SELECT p, e, v, list_inner_product(v, v) AS vv FROM (
    SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, [floor({SCALE} * CAST(c AS DOUBLE)) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
),
t AS (SELECT *, list_inner_product(v, v) AS vv FROM (
  SELECT r, vec_id, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p))),
c0 AS (SELECT p, e - 1 AS e, v, vv FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM t) WHERE e <= {ENTRIES}),
{",".join(rounds)},
coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
),
books AS (
  SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h
  FROM c{ROUNDS}, (SELECT unnest(range(1, (SELECT len(v) FROM t LIMIT 1) + 1)) AS i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), books
"""
