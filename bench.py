"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the star-schema tables (default /root/testdata/sf0.1)
BENCH_CPUS: local cores (default 8)
"""

from __future__ import annotations

import json
import os
import time

from hubloom.plans.catalog import QUERIES
from hubloom.session import build_session

HEADLINE = [
    "order_items", "weekly_demand", "flow_share_report", "hub_freight_report",
    "moving_average_report", "state_hub_distances", "naive_planning_demand", "freight_line",
    "plan_costs", "optimal_placement", "capacity_sensitivity", "scenario_results",
    "whatif_grid", "ridge_holdout", "routing_model_flows", "model_scenario_results",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", spark__master=f"local[{cpus}]", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus,
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED", "spark-warehouse/_bench"),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scenario_results"](spark, folder).collect()  # warm up the JVM

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
