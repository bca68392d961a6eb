"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores. A
query is built and its whole result computed into a sink that keeps nothing; a fit
counts, because building the query runs it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.catalog import QUERIES  # noqa: E402
from tablewright.session import build_session, clear_scratch  # noqa: E402

HEADLINE = [
    "missing_report", "numeric_summary_lineitem", "categorical_summary", "association_report", "nullity_correlation", "drop_duplicate_rows",
    "drop_near_duplicates", "drop_repeated_keys", "stratified_split", "undersample", "balanced_bags", "log_iqr", "early_dates", "proportional_fill",
    "group_mode_fill", "group_median_fill_fallback", "target_encoder_high_cardinality", "frequency_encoder", "spearman_matrix", "nearest_neighbors",
    "classification_report", "threshold_sweep", "roc_auc", "stage_loss", "prepared_class_summary", "prepared_claims", "weighted_multiclass",
    "cascade_classifier",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="tablewright-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    clear_scratch(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
