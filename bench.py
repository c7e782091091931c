"""Wall time of each query: `BENCH_SF_DIR` (data) on `local[BENCH_CPUS]`.

Prints one JSON line. Each query is planned and run to its end, without collecting
its rows; one of under QUICK seconds runs RUNS times, and the median counts. Fixture
tables that the queries read are derived from the given tables and stored first;
that time is shown as `fixtures` and counts in the total. `BENCH_QUERIES` may name
some queries only.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from clickloom.fixtures import VIEWS
from clickloom.registry import QUERIES, stored_views

RUNS, QUICK = 3, 2.0


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    taken: list[float] = []
    while len(taken) < RUNS and (not taken or taken[-1] < QUICK):
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - begun)
    return round(median(taken), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clickloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    begun = time.perf_counter()
    stored_views(spark, sf_dir, [*VIEWS, "admissions"])
    seconds["fixtures"] = round(time.perf_counter() - begun, 3)
    for name in chosen:
        seconds[name] = timed(spark, name, sf_dir)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
