"""Times headline audits; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose
data and cores.  Every query is run twice to warm up and then timed ``BENCH_RUNS``
times (default 3); the median counts.  ``BENCH_DUCKDB=1`` adds the time DuckDB needs
for the same SQL on the same cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.oracles import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "steps_two_joins", "steps_compounding", "steps_many_to_many", "steps_theta", "steps_residual",
    "steps_siblings", "steps_hot_key", "steps_hot_self_join", "key_stats_tables", "exact_duplicates_lineitem",
    "fix_preaggregate", "fix_keep_latest", "agg_inflation",
]


def timed(run, runs: int) -> float:
    for _ in range(2):
        run()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def duckdb_times(folder: str, cpus: int, names: list[str], runs: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cpus})
    for file in sorted(os.listdir(folder)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    return {n: timed(lambda n=n: con.execute(ORACLES[n]).fetchall(), runs) for n in names}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # noop writes every row without moving it to the driver
    times = {n: timed(lambda n=n: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save(),
                      runs) for n in names}
    spark.stop()
    out = {"metric": "headline_audits_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}
    if os.environ.get("BENCH_DUCKDB"):
        out["duckdb"] = duckdb_times(folder, cpus, names, runs)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
