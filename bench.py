"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then RUNS times into the noop sink; the median
counts. ``value`` is the sum over all queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = [
    "fill_group_mean", "fill_mean", "fill_median", "fill_group_median", "fill_mode", "ffill", "bfill",
    "missing_summary", "suggest_cleaning", "duplicate_stats", "duplicate_rows",
    "suggest_types", "convert_double", "narrow_types",
    "clean_all", "title_case", "fuzzy_pairs",
    "cap_outliers", "zscore_outliers", "local_outlier_factors",
    "overview", "column_stats", "quality_score", "findings", "select_features",
    "pearson", "spearman",
    "pivot_sum", "pivot_multi", "pivot_margins",
    "one_hot", "label_encode", "scale_standard", "scale_robust", "datetime_parts", "polynomial",
    "histogram", "box_stats", "with_position",
    "classification_metrics", "roc_auc", "regression_errors", "knn_predict",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in HEADLINE:
        spent = []
        for run in range(RUNS + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                spent.append(time.perf_counter() - started)
        times[name] = round(statistics.median(spent), 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
