"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellgauge.catalog import QUERIES
from cellgauge.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "scan_network",
    "validation_report",
    "duplicate_keys",
    "describe_numeric",
    "correlation_matrix",
    "preprocess",
    "latency_by_location",
    "boxplot_by_location",
    "horizontal_check",
    "stratified_split",
    "standard_scale",
    "model_comparison",
    "subset_metrics",
    "significance_pairs",
    "wilcoxon",
    "residual_qq",
    "model_monolithic",
    "job_vertical",
    "job_horizontal",
    "model_cross_validation",
    "evaluation_bundle",
]


def main() -> None:
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_network"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        spark.catalog.clearCache()
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
