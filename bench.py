"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the test tables   (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                 (default 8)
BENCH_RUNS     timed runs per query        (default 3; the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from fleetspark import build_session
from fleetspark.catalog.queries import QUERIES

HEADLINE = [
    "clean_telemetry",
    "machine_activity",
    "sample_1min",
    "sample_10min",
    "moving_averages",
    "machine_summary",
    "attribute_summary",
    "column_summary",
    "correlation_matrix",
    "map_points",
    "map_points_ma",
    "fuel_by_month_pivot",
    "speed_ratio_pivot",
    "concurrent_hours",
    "grid_heatmap",
    "zone_grid",
    "every_nth",
    "field_centers",
    "in_field",
    "nearest_center",
    "session_rows",
    "session_times",
    "session_trace",
    "q1_time_split",
    "q2_field_count",
    "q3_activities",
    "q6_road_fuel",
]


def run_once(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "fleetspark-bench",
        master=f"local[{cpus}]",
        extra={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(run_once(name, spark, sf_dir), 3)
        warm[name] = round(statistics.median(run_once(name, spark, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "fleet_telemetry_headline_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "first_run": cold,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
