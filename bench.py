"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no collection to
the driver) after one warm-up query; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from raretab.plans.catalog import REGISTRY  # noqa: E402
from raretab.session import local_session  # noqa: E402

HEADLINE = [
    "clean_table",              # dedup + grouped exact medians + impute + features
    "dedup_summary",
    "grouped_median_lineitem",  # exact medians on the largest table
    "class_means",
    "box_summary",              # exact quartiles per feature x class
    "correlation_matrix",
    "mann_whitney",             # bucketed ranks
    "chi_square",
    "test_battery",
    "kde_grid",
    "split_membership",         # exact stratified 64/16/20
    "fold_membership",
    "permuted_labels",
    "roc_auc",
    "average_precision",
    "threshold_sweep",
    "results_table",
    "knn_minority",
    "smote_synthetic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "16")),
                          app="raretab-bench")
    # warm-up: JVM, codegen caches, parquet footers
    REGISTRY["class_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
