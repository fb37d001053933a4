"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); BENCH_QUERIES may
name other queries, separated by commas, or be "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from delaylens.plans import REGISTRY, run  # noqa: E402
from delaylens.session import local_session  # noqa: E402
from delaylens.sources.tables import Tables  # noqa: E402

HEADLINE = (
    "delay_kpis", "delay_rate_by_hour", "origin_month_matrix", "monthly_carrier_volume",
    "top_airport_route_delay", "cancel_rate_month", "carrier_reliability", "anomaly_causes",
    "delay_cause_share", "airport_activity", "max_daily_carrier_distance", "top_routes_month",
    "speed_distribution", "daily_rolling", "daily_lags", "travel_yearly", "segment_stats",
    "segment_priors", "ripple_matches", "ripple_incidents", "station_impacts", "ripple_timeline",
    "ripple_dataset", "temporal_split", "stratified_split", "roc_auc", "average_precision",
    "threshold_sweep", "classification_report", "logistic_delay_model",
    "isolation_forest_causes", "daily_rolling_model", "carrier_rolling_forecast", "overall_rolling_forecast",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(cpus)
    tables = Tables(spark, folder)
    tables.read("lineitem").count()  # start the executor threads before the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
