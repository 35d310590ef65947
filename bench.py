"""Time the headline queries; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS``
(default 8).  Every query is evaluated in full, into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from admeter.session import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "platform_comparison", "platform_comparison_orders", "clean_rows", "dedup_keep_last", "numeric_validation_report",
    "kpi_core", "kpi_unit_economics", "goal_kpis", "row_summary_metrics", "cohort_payload", "cohort_batches",
    "cohort_row_position", "kpi_trend", "weak_traffic", "value_leakage", "analysis_valid", "recommendation_valid",
    "evaluation_valid", "cards_exploded", "latest_response", "version_summary_analysis", "last_n_runs",
    "analysis_prompts", "figures_checked", "banned_words",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app_name="bench", memory="12g")
    QUERIES["platform_comparison"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
