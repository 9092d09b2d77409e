"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from huntframe.queries.catalog import QUERIES  # noqa: E402
from huntframe.session import build_session  # noqa: E402

HEADLINE = [name for name in QUERIES if name.startswith("P")] + [
    "T1_make_series", "T2_T3_series_anomaly", "A08_percentile", "A09_make_set", "A13_arg_max_all",
    "F21_has", "F23_has_any", "J01_inner", "J01_inner_salted", "J02_innerunique",
    "J13_ordered_within_window", "B02_complexity_tier", "B04_audit", "B05_stratified_split",
    "B11_bootstrap_ci", "B14_rater_agreement", "B17_tfidf_search", "X06_parse",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    wanted, seconds = sys.argv[1:], {}
    for name in HEADLINE if not wanted else [n for n in QUERIES if n.startswith(tuple(wanted))]:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of two runs", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
