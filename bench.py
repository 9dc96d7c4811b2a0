"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tassel.session import build_session  # noqa: E402
from verification.registry import load_all  # noqa: E402

HEADLINE = [
    "course_features",
    "dfwi_by_course",
    "gateway_funnel",
    "co_enrollment_all_pairs",
    "all_pair_breakdowns",
    "student_table",
    "scored_students",
    "readiness_records",
    "kpis",
    "risk_alert_distribution",
    "chart_retention_by_demographic",
    "summary_report",
    "roster_worst_first",
    "enrollments_with_predictions",
    "conform_enrollments",
    "detect_schemas",
    "upsert",
    "upload_diffs",
    "stratified_split",
    "binary_metrics",
    "exact_quantiles",
    "drop_same_words_documents",
    "stream_daily_counts",
    "train_retention_forest",
]
RUNS = 3
#: Run once: minutes, or rounds that write.
LONG = {"train_retention_forest", "stream_daily_counts"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tassel-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            # small files still make a split for each core
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    wanted = sys.argv[1:] or HEADLINE
    # one small run first, so that the first query does not pay for starting up
    entries["dfwi_by_course"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        runs = []
        for _ in range(1 if name in LONG else RUNS):
            start = time.perf_counter()
            entries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
