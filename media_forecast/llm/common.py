"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from media_forecast.session import stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:

    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(df: DataFrame) -> int:
    """Number of buckets for keyed array work: follows the input's partitions and the session's setting."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions())


_KEPT: dict = {}


def kept_by_worker(operator: str, key=None, make: Callable = dict):
    """``make()``, made once per worker process for ``key`` while its tasks belong to one operator.

    Workers are reused: the first task of another operator drops what was kept
    before, so that memory does not add up over the stages of a pipeline.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        gc.collect()
        _KEPT[operator] = {}
    kept = _KEPT[operator]
    if key not in kept:
        kept[key] = make()
        # What was just loaded lives on: later searches for cycles need not look at it.
        gc.freeze()
    return kept[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, comp)``, comp the smallest node reached.

    Alternates large-star and small-star steps. Every step is a combinable
    minimum per node and a join, so a star of any size is pre-aggregated
    before the shuffle. Nodes without an edge are not listed. Null or equal
    ends are ignored; repeated edges count once.
    """
    cur = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "cc",
    )
    before = None
    while True:
        # Large star: every neighbour above u links to the smallest of u's closed neighbourhood.
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (
            both.join(low, both["a"] == low["u"]).where("b > a")
            .select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        )
        # Small star: u and its smaller neighbours link to the smallest of them.
        low2 = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        joined = large.join(low2, large["b"] == low2["u"])
        small = (
            joined.select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m")
            .select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        )
        cur = stored(small, "cc")
        # Every node but the roots hangs below exactly one root once the edges are stars.
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return cur.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionAll(
        cur.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    )
