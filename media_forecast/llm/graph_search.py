"""Operator 6: approximate nearest neighbours on robust-pruned directed graphs.

Index: equal vectors form one class, kept with its ``k + 1`` smallest ids (no
answer can need more of them); the ids are limited per task before the shuffle,
so a vector that a third of all rows share stays small. Classes are dealt by
hash into shards of about ``SHARD``, and each shard is one graph. Points enter
in batches: a greedy beam search proposes neighbours, robust pruning keeps a
candidate only if no kept one is nearer to it by the factor ``ALPHA``, and
edges go both ways, pruned again where they overflow. Points that no path
reaches get an edge from their nearest reached point. Every class is indexed.

Search: every query runs a beam search of width ``BEAM`` in every shard, in
blocks of ``QUERY_BLOCK`` queries, so neither side of a task grows with the
table. Distances are Euclidean, in double precision on the stored vectors.

Vectors that are null, empty, zero, or hold a null or non-finite component
take no part; vectors of another dimension are never neighbours. Repeated ids
count as rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from media_forecast.llm.common import stored
from media_forecast.shipping import ship_package

SHARD, QUERY_BLOCK = 3000, 1024
DEGREE, BEAM, ALPHA = 32, 128, 1.2
NEAREST = 10


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam searches of all rows of q at once: (ids, squared distances), nearest first, id -1 where none."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf)
    done = np.ones((n, width), bool)  # expanded, or no entry
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((q - x[start]) ** 2).sum(1)
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    while True:
        live = rows[~done.all(1)]
        if not len(live):
            return ids, dist
        pick = np.argmin(done[live], axis=1)  # beams are sorted: the nearest not yet expanded
        done[live, pick] = True
        cand = edges[ids[live, pick]]
        fresh = (cand >= 0) & ~seen[live[:, None], cand]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        target = cand[r, c]
        seen[live[r], target] = True
        near = np.full(cand.shape, np.inf)
        diff = x[target] - q[live[r]]
        near[r, c] = np.einsum("ij,ij->i", diff, diff)
        all_dist = np.concatenate([dist[live], near], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, cand, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        dist[live] = np.take_along_axis(all_dist, order, 1)
        ids[live] = np.take_along_axis(all_ids, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)


def robust_prune(x: np.ndarray, p: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of p among the candidates."""
    cand = np.unique(candidates)
    cand = cand[(cand >= 0) & (cand != p)]
    diff = x[cand] - x[p]
    dist = np.einsum("ij,ij->i", diff, diff)
    order = np.argsort(dist, kind="stable")
    cand, dist = cand[order], dist[order]
    kept = []
    while len(cand) and len(kept) < degree:
        best = cand[0]
        kept.append(best)
        diff = x[cand] - x[best]
        stay = alpha * alpha * np.einsum("ij,ij->i", diff, diff) > dist
        stay[0] = False
        cand, dist = cand[stay], dist[stay]
    return np.array(kept, np.int64)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 128) -> tuple[np.ndarray, int]:
    """(edges padded with -1, start) over the rows of x, which are distinct."""
    n = len(x)
    wide = 2 * degree
    edges = np.full((n, wide), -1, np.int64)
    count = np.zeros(n, np.int64)
    start = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))

    def put(p: int, found: np.ndarray) -> None:
        edges[p] = -1
        edges[p, : len(found)] = found
        count[p] = len(found)

    order = np.random.default_rng(7).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        group = order[at: at + size]
        ids, _ = beam_search(x, edges, start, x[group], beam)
        for p, found in zip(group, ids, strict=True):
            put(p, robust_prune(x, p, np.concatenate([found, edges[p]]), degree, alpha))
        for p in group:
            for o in edges[p, : count[p]]:
                if count[o] == wide:
                    put(o, robust_prune(x, o, np.append(edges[o], p), degree, alpha))
                elif p not in edges[o, : count[o]]:
                    edges[o, count[o]] = p
                    count[o] += 1
        at, size = at + size, min(batch, 2 * size)
    for p in np.flatnonzero(count > degree):
        put(p, robust_prune(x, p, edges[p], degree, alpha))
    return connect(x, edges, start), start


def connect(x: np.ndarray, edges: np.ndarray, start: int) -> np.ndarray:
    """Adds an edge from the nearest reached point to every point that no path reaches."""
    reached = np.zeros(len(x), bool)
    reached[start] = True

    def follow(front: np.ndarray) -> None:
        while len(front):
            nxt = np.unique(edges[front])
            nxt = nxt[nxt >= 0]
            front = nxt[~reached[nxt]]
            reached[front] = True

    follow(np.array([start]))
    for p in range(len(x)):
        if reached[p]:
            continue
        have = np.flatnonzero(reached)
        near = have[np.argmin(((x[have] - x[p]) ** 2).sum(1))]
        free = np.flatnonzero(edges[near] < 0)
        if not len(free):
            edges = np.concatenate([edges, np.full((len(x), 4), -1, np.int64)], axis=1)
            free = np.flatnonzero(edges[near] < 0)
        edges[near, free[0]] = p
        reached[p] = True
        follow(np.array([p]))
    return edges


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False)))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, members): distinct vectors, each with its k + 1 smallest distinct ids."""
    first = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.select("vec_id", "embedding").withColumn("nth", first).where(F.col("nth") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("members"))


def search(
    rows: DataFrame, queries: DataFrame, k: int = NEAREST, shard: int = SHARD, beam: int = BEAM, degree: int = DEGREE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all rows but its own id.

    Repeated rows and repeated queries count once; queries of one id with different vectors are ranked each by itself.
    """
    ship_package(rows.sparkSession)
    rows, queries = usable(rows), usable(queries)
    base = stored(classes(rows, k), "vectors")
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").distinct().withColumn("vector", F.xxhash64("embedding"))
    n, nq = base.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-nq // QUERY_BLOCK))
    # A shard holds vectors of one dimension.
    dealt = base.withColumn("shard", F.concat_ws("-", F.size("embedding"), F.pmod(F.xxhash64("embedding"), F.lit(shards))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("members", key=lambda s: s.map(lambda m: m[0])).reset_index(drop=True)
        edges, start = build_graph(np.array(pdf["embedding"].tolist(), np.float64), degree, beam)
        return pdf.assign(
            node=np.arange(len(pdf)), is_start=np.arange(len(pdf)) == start, edges=[e[e >= 0].tolist() for e in edges]
        )

    kind = base.schema["embedding"].dataType.simpleString()
    graph = stored(
        # Few bytes and much work a shard: a task each, whatever their size.
        dealt.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(
            build, f"embedding {kind}, members array<long>, shard string, node int, is_start boolean, edges array<int>"
        ), "graph",
    )
    homes = graph.select(F.col("shard").alias("home")).distinct()
    to = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long")).withColumn("dim", F.size("embedding").cast("string"))
    # The stated query set against all shards, in blocks.
    sent = to.join(homes.withColumn("dim", F.substring_index("home", "-", 1)), "dim").select("home", "block", "query_id", "embedding", "vector")
    copies = graph.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def ask(index: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(q):
            index = index.sort_values("node")
            x = np.array(index["embedding"].tolist(), np.float64)
            y = np.array(q["embedding"].tolist(), np.float64)
            members, lists = index["members"].tolist(), index["edges"].tolist()
            edges = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int64)
            for i, e in enumerate(lists):
                edges[i, : len(e)] = e
            start = int(np.argmax(index["is_start"].to_numpy()))
            for lo in range(0, len(y), 128):
                ids, _ = beam_search(x, edges, start, y[lo: lo + 128], max(beam, k + 1))
                part = q.iloc[lo: lo + 128]
                for row, query, own, vector in zip(ids, y[lo: lo + 128], part["query_id"], part["vector"], strict=True):
                    row = row[row >= 0]
                    score = np.sqrt(((x[row] - query) ** 2).sum(1))
                    hits = sorted((s, m) for s, i in zip(score, row, strict=True) for m in members[i] if m != own)
                    out += [(own, vector, m, s) for s, m in hits[:k]]
        return pd.DataFrame(out, columns=["query_id", "vector", "vec_id", "score"])

    hits = copies.groupBy("shard", "block").cogroup(sent.groupBy("home", "block")).applyInPandas(
        ask, "query_id long, vector long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
