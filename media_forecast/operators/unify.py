"""Union of channel frames + per-row ratios (ROAS, CPC, CVR)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safe_ratio
from ..sources.schema import UNIFIED_COLUMNS, UNIFIED_SCHEMA
from ..sources.vendors import conform


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "roas": safe_ratio("revenue", "spend"),
        "cpc": safe_ratio("spend", "clicks"),
        "cvr": safe_ratio("conversions", "clicks"),
    })


def unify(frames: Iterable[DataFrame | None], spark: SparkSession | None = None) -> DataFrame:
    """Union-all of the supplied channel frames (any subset) with derived ratios.

    Absent frames are skipped; no frames at all gives an empty unified table.
    No sort here: ordering is applied only where a result is published.
    """
    present = [conform(f) for f in frames if f is not None]
    if not present:
        if spark is None:
            raise ValueError("no channel frames and no session to build an empty table")
        return spark.createDataFrame([], UNIFIED_SCHEMA)
    return with_ratios(reduce(lambda a, b: a.unionByName(b), present))


# Tie-breakers make date order deterministic (dates repeat across campaigns).
ORDER_KEYS = ["date", "channel", "campaign_id", "campaign_name", "spend", "revenue",
              "clicks", "impressions", "conversions", "daily_budget"]


def sort_unified(df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER_KEYS])


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` rows in date order (a top-n, planned as TakeOrderedAndProject)."""
    return sort_unified(df).limit(n).select(*UNIFIED_COLUMNS, "roas", "cpc", "cvr")
