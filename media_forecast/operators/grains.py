"""Several grains from one pass: grouping sets with a grain column.

The daily rows are combined once, to one row per campaign, type and week;
grouping sets then run over these rows alone, so the raw rows are read and
shuffled once whatever the number of grains, and no raw row is multiplied.
Sums stay decimals between the two steps: every grain equals, to the last
digit, the roll-up of the raw rows at that grain.

A grain's key that is missing in the data is told apart from one that the
grain does not have by the grouping flags: such groups are kept, marked
``key_missing``, and carry their number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import exact, exact_sum, out_round, safe_ratio, week_start
from .kpis import GRAINS, dated

TOTAL = "total"  # grain without keys: all channels together
MONEY_SUMS = ("spend", "revenue", "conversions")
COUNT_SUMS = ("clicks", "impressions")


def _flag(key: str) -> str:
    return f"__left_out_{key}"


def _same_keys(key_list: list[str], used: list[str]) -> Column:
    cond = F.lit(True)
    for k in key_list:
        cond = cond & (F.col(_flag(k)) == F.lit(0 if k in used else 1))
    return cond


def weekly_grains(df: DataFrame, grains: dict[str, list[str]] | None = None,
                  undated: Observation | None = None) -> DataFrame:
    """Weekly sums of all ``grains`` (name → keys) and of everything together.

    Columns: ``grain``, the keys (null where the grain has none), ``week``,
    the sums, ``roas``, ``rows`` and ``key_missing``. Rows without a date fail
    or are counted by ``undated``. Empty input gives no rows.
    """
    grains = dict(GRAINS if grains is None else grains)
    if TOTAL in grains:
        raise ValueError(f"{TOTAL!r} is the grain without keys")
    if len({frozenset(v) for v in grains.values()}) < len(grains) or not all(grains.values()):
        raise ValueError("every grain needs keys of its own")
    key_list = list(dict.fromkeys(k for keys in grains.values() for k in keys))
    fine = dated(df, [], undated).groupBy(*key_list, week_start("date").alias("week")).agg(
        *[F.sum(exact(c)).alias(c) for c in MONEY_SUMS],
        *[F.sum(c).alias(c) for c in COUNT_SUMS],
        F.count(F.lit(1)).alias("rows"),
    )
    sets = [[*keys, "week"] for keys in grains.values()] + [["week"]]
    rolled = fine.groupingSets(sets, *key_list, "week").agg(
        *[F.grouping(k).alias(_flag(k)) for k in key_list],
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in MONEY_SUMS],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNT_SUMS],
        F.sum("rows").alias("rows"),
    )
    name = F.lit(TOTAL)
    for grain, keys in grains.items():
        name = F.when(_same_keys(key_list, keys), F.lit(grain)).otherwise(name)
    missing = F.lit(False)
    for k in key_list:
        missing = missing | ((F.col(_flag(k)) == 0) & F.col(k).isNull())
    return rolled.select(
        name.alias("grain"), *key_list, "week", "spend", "revenue", "clicks", "impressions", "conversions",
        safe_ratio("revenue", "spend").alias("roas"), "rows", missing.alias("key_missing"))


def of_grain(rolled: DataFrame, grain: str, keys: list[str] | None = None) -> DataFrame:
    """One grain of :func:`weekly_grains` as :func:`kpis.weekly` gives it (groups with a missing key left out)."""
    keys = keys if keys is not None else GRAINS.get(grain, [])
    return rolled.filter((F.col("grain") == grain) & ~F.col("key_missing")).select(
        *keys, "week", "spend", "revenue", "clicks", "impressions", "conversions", "roas")


def left_out(rolled: DataFrame) -> DataFrame:
    """Per grain: rows and money of groups without a key, beside those of the whole grain."""
    gone = F.col("key_missing")
    return rolled.groupBy("grain").agg(
        F.sum("rows").alias("rows"), exact_sum("spend").alias("spend"), exact_sum("revenue").alias("revenue"),
        F.coalesce(F.sum(F.when(gone, F.col("rows"))), F.lit(0)).alias("rows_without_key"),
        exact_sum(F.when(gone, F.col("spend"))).alias("spend_without_key"),
        exact_sum(F.when(gone, F.col("revenue"))).alias("revenue_without_key"),
    )


def with_blended(forecast: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every series' scenario result and the blended row of its scenario, the forecast being run once.

    ``blended`` marks the row of all series, whose keys are null; its ROAS is
    over all planned spend.
    """
    keys = keys or ["channel"]
    g = forecast.groupingSets([["scenario_id", *keys], ["scenario_id"]], "scenario_id", *keys).agg(
        (F.grouping(keys[0]) == 1).alias("blended"),
        exact_sum("planned_spend").alias("total_spend"),
        *[out_round(exact_sum(f"revenue_{q}")).alias(f"revenue_{q}") for q in ("low", "median", "high")],
    )

    def roas(q: str) -> Column:
        spend = F.col("total_spend")
        return F.when(spend != 0, out_round(F.col(f"revenue_{q}") / spend)).otherwise(F.lit(0.0)).alias(f"roas_{q}")
    return g.select("*", *[roas(q) for q in ("low", "median", "high")])


def range_table(rows: DataFrame) -> DataFrame:
    """Low, width of the band and median per channel, and blended, from :func:`with_blended`."""
    return rows.select(
        "scenario_id", F.when(F.col("blended"), F.lit("blended")).otherwise(F.col("channel")).alias("channel"),
        "revenue_low", out_round(F.col("revenue_high") - F.col("revenue_low")).alias("band"), "revenue_median")
