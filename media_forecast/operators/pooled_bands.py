"""Ratio bands for short series, pooled from mergeable quantile sketches.

The sketch of a set of ratios (revenue over fitted revenue) is a histogram
whose bucket borders grow by one factor, so every value of a bucket is within
``accuracy`` of its middle, relatively. It is kept as rows (pool, bucket,
count): sketches merge by adding counts, in any order and to the same result,
and their number of rows depends on the spread of the ratios, not on how many
there are. A quantile of a sketch is the middle of the bucket that holds the
value of that rank: the rank is exact, the value off by ``accuracy`` at most.

Series pool upwards (campaign type, channel, everything). A series takes the
first pool with at least ``min_pool`` ratios, its own included, and shrinks
towards it: weight n_weeks / full_weeks on its own exact band, 1 from
``full_weeks`` on. A convex mix of two ordered bands is ordered.

A series without a positive fit has the neutral own band 1; without any ratio
in the data the pool is neutral too. Null and NaN ratios are left out; zero
and negative ratios have buckets of their own. No weeks give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nan_to_null, out_round
from ..session import stored
from . import models

FULL_WEEKS = 12  # weeks from which on a series' own band stands alone
MIN_POOL = 30  # ratios that a pool needs
ACCURACY = 0.01
POOLS = [["channel", "campaign_type"], ["channel"], []]
ZERO_AT = 1 << 40  # buckets of positive values lie above 0, those of negative ones below: far beyond any logarithm
BANDS = {f"r{round(q * 100)}": q for q in models.QUANTILES}


def growth(accuracy: float = ACCURACY) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy lies between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """Number of the value's bucket, in the order of the values."""
    at = F.ceil(F.log(F.abs(value)) / F.lit(math.log(growth(accuracy)))).cast("long") + F.lit(ZERO_AT)
    return F.when(value > 0, at).when(value < 0, -at).otherwise(F.lit(0).cast("long"))


def middle(number: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket, within ``accuracy`` of all it holds."""
    g = growth(accuracy)
    size = F.lit(2.0 / (g + 1.0)) * F.pow(F.lit(g), (F.abs(number) - F.lit(ZERO_AT)).cast("double"))
    return F.when(number > 0, size).when(number < 0, -size).otherwise(F.lit(0.0))


def sketch(rows: DataFrame, keys: list[str], value: str = "ratio", accuracy: float = ACCURACY) -> DataFrame:
    """(keys, bucket, n) of the values of each group."""
    v = nan_to_null(value)
    return rows.filter(v.isNotNull()).groupBy(*keys, bucket(v, accuracy).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, or of the union of several tables of sketches."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, float] | None = None,
              accuracy: float = ACCURACY) -> DataFrame:
    """(keys, values, one column per quantile): the value of rank floor(q * (values - 1)), from 0."""
    wanted = BANDS if wanted is None else wanted
    group = Window.partitionBy(*keys)  # one row per bucket: bounded by the spread of the values
    ranked = sketches.select(
        *keys, middle(F.col("bucket"), accuracy).alias("value"), F.sum("n").over(group).alias("values"),
        F.sum("n").over(group.orderBy("bucket")).alias("upto"))

    def reached(q: float) -> Column:
        return F.col("upto") > F.floor(F.lit(q) * (F.col("values") - F.lit(1)).cast("double"))
    return ranked.groupBy(*keys).agg(
        F.max("values").alias("values"),
        *[F.min(F.when(reached(q), F.col("value"))).alias(name) for name, q in wanted.items()])


def pooled_bands(weekly_df: DataFrame, keys: list[str], pools: list[list[str]] | None = None,
                 full_weeks: int = FULL_WEEKS, min_pool: int = MIN_POOL, accuracy: float = ACCURACY) -> DataFrame:
    """Per series: n_weeks, pool, pool_values, own_weight and the band r10, r50, r90 (6 dp)."""
    pools = POOLS if pools is None else pools
    if any(not set(up) <= set(low) for low, up in zip([keys, *pools], pools)):
        raise ValueError("every pool's keys must be among those of the one before")
    # One row per series, stored: its own band and the pools' sketches come from one fit.
    fits = stored(models.series_fits(weekly_df, keys), "fits")
    joined = models.banded(fits).drop("ratios")
    level = stored(sketch(fits.select(*pools[0], F.explode("ratios").alias("ratio")), pools[0], accuracy=accuracy), "sketch")
    for i, pool in enumerate(pools):
        level = merge(level, pool) if i else level
        bands = quantiles(level, pool, accuracy=accuracy)
        named = bands.select(*pool, *[F.col(c).alias(f"__{i}_{c}") for c in ("values", *BANDS)])
        # A pool without keys is one row.
        joined = joined.join(named, pool, "left") if pool else joined.join(F.broadcast(named), F.lit(True), "left")
    found = [F.col(f"__{i}_values") >= min_pool for i in range(len(pools))]

    def of_pool(value, otherwise: Column) -> Column:
        return F.coalesce(*[F.when(ok, value(i)) for i, ok in enumerate(found)], otherwise)

    weight = F.least(F.col("n_weeks") / F.lit(float(full_weeks)), F.lit(1.0))
    out = joined.select(
        *keys, "n_weeks",
        of_pool(lambda i: F.lit("+".join(pools[i]) or "all"), F.lit("none")).alias("pool"),
        of_pool(lambda i: F.col(f"__{i}_values"), F.lit(0)).cast("long").alias("pool_values"),
        weight.alias("w"), *BANDS,
        *[of_pool(lambda i, b=b: F.col(f"__{i}_{b}"), F.lit(1.0)).alias(f"__{b}") for b in BANDS])
    w = F.col("w")
    return out.select(
        *keys, "n_weeks", "pool", "pool_values", out_round("w", 6).alias("own_weight"),
        *[out_round(F.when(w >= 1, F.col(b)).otherwise(w * F.col(b) + (F.lit(1.0) - w) * F.col(f"__{b}")), 6).alias(b)
          for b in BANDS])
