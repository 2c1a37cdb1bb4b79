"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from riskflow.catalog import REGISTRY
from riskflow.session import settings_for

HEADLINE = [
    "bank_report",
    "w1_bank_report_files",
    "w2_dynamic_threshold",
    "w3_event_level",
    "w4_static_thresholds",
    "w5_json_staging",
    "w6_flagged_events",
    "f1_conjunction",
    "f12_filter_list",
    "p6_cast_columns",
    "p17_expression",
    "g1_group_by",
    "g6_distinct_two_stages",
    "g11_median",
    "g11_median_large_groups",
    "g12_first_last",
    "g16_collect_rows",
    "s5_json_ingest",
    "s9_nested_json",
    "l2_list_in_column",
    "l7_list_not_in_list",
    "z1_map_partitions",
    "z6_combine_groups",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("riskflow-bench")
    size = sum(path.stat().st_size for path in Path(folder).glob("*.parquet"))
    settings = settings_for(size, int(cpus)) | {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session also starts code generation; it is not measured.
    REGISTRY["bank_report"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            started = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": f"headline queries, best of {RUNS} runs each, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(folder).name.removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
