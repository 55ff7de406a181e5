"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fleetline import catalog  # noqa: E402
from fleetline.plans.rollup_queries import prepare  # noqa: E402

HEADLINES = {
    "scorecard": "R06_scorecard",
    "route_metrics_overlay": "R01_route_metrics_overlay",
    "ewt_headline": "E23_ewt_headline",
    "bunching_causes": "E26_bunching_causes",
    "segment_slip": "X03_segment_slip",
    "aggregate_runs": "D09_aggregate_runs",
    "state_fold": "T03_trip_update_state_fold",
    "nearest_stop": "D02_nearest_stop_within",
    "proximity_events": "D05_derive_stop_events_proximity",
    "block_timeline": "X16_block_timeline",
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    start = time.perf_counter()
    prepare(spark, sf_dir)  # what a deployment stores; counted, as everything below reads it
    took["build_store"] = round(time.perf_counter() - start, 3)
    for name, key in HEADLINES.items():
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir}))


if __name__ == "__main__":
    main()
