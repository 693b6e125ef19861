"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is run to completion with a full-result action (a count over
every output row is not enough for Spark: it could prune columns), so the
timing covers the whole plan. One warm-up query loads the JVM first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from media_forecast.plans import catalog  # noqa: E402
from media_forecast.session import local_session  # noqa: E402

HEADLINE = [
    "unified_daily",
    "weekly_channel",
    "weekly_campaign",
    "channel_metrics",
    "dq_counts",
    "dq_duplicate_rows",
    "dq_missing_dates",
    "dq_zero_revenue_top_spend",
    "dq_extreme_roas_top",
    "features_weekly",
    "spend_response_fit",
    "scenario_forecast",
    "scenario_blended",
    "backtest_runs",
    "backtest_score",
    "backtest_score_campaign",
    "campaign_allocation",
    "trend_fit",
    "quantile_fit",
    "campaign_scenario_forecast",
]


def run_query(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()  # includes plan building and any eager checkpoint it does
    df = catalog.QUERIES[name](spark, sf_dir)
    # Write to the no-op sink: every row and column is computed, nothing is collected.
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    run_query(spark, "weekly_channel", sf_dir)  # warm-up: JVM, codegen caches
    times = {}
    for name in names:
        times[name] = round(run_query(spark, name, sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
