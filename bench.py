"""Time the headline queries from source tables to result, one JSON line on stdout.

Each query starts without stage tables, so its time covers the scan of ``lineitem`` and
every stage it needs. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` select data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("assemble_daily_panel", "universe_membership", "relative_returns", "detect_events", "event_outcomes", "hypothesis_tests",
            "trailing_correlation_peers", "characteristic_relationships", "threshold_sweep", "data_audit", "random_peer_placebo",
            "selection_preserving_null")


def main() -> None:
    from peerwake.plans import catalogue  # noqa: F401
    from peerwake.plans.registry import all_queries
    from peerwake.plans.workspace import forget

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("peerwake-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in names:
        forget(spark)
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
