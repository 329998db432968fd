"""Benchmark the registered queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
``/root/testdata/sf0.1``) and prints ONE JSON line.

Protocol: the marts are built once from the source tables and written under
the checkpoint folder (timed as ``mart_build``; this is the upstream job of
the dashboard).  Then every registered key runs once as a warm-up and three
times timed; the per-key figure is the median.  ``value`` is the sum of the
per-key medians.  Large outputs (the fact builds) are executed into Spark's
``noop`` sink instead of being collected, so the timing is the job, not the
transfer of half a million rows into Python.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ONLY = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]

# Keys whose result is a whole fact or a write: run into the noop sink.
NOOP_KEYS = {"build_fact_sales", "build_fact_orders", "build_fact_events",
             "build_dim_products", "filter_all", "category_pairs", "graph_edges",
             "co_purchase_matrix"}


def _sf_of(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    from warung.session import checkpoint_root, get_session
    # spark.checkpoint.dir is taken from the session; a fresh folder is made
    # only when it is unset (see warung.session.checkpoint_root).
    spark = get_session(f"local[{CPUS}]", app="warung-bench", shuffle_partitions=CPUS,
                        extra={"spark.driver.memory": "16g"})
    checkpoint_root(spark)
    from warung.plans import catalog

    t0 = time.time()
    for name in ("fact_sales", "fact_orders", "fact_events", "dim_products", "sales_rollup", "category_pairs"):
        catalog._marts(spark, SF_DIR)[name]
    mart_build = time.time() - t0
    t0 = time.time()
    catalog._forecast_tables(spark, SF_DIR)          # the forecast build; its page keys read the written tables
    forecast_build = time.time() - t0

    keys = ONLY or list(catalog.REGISTRY)

    def run(key: str) -> None:
        df = catalog.REGISTRY[key].run(spark, SF_DIR)
        if key in NOOP_KEYS:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for key in keys:
        try:
            run(key)  # warm-up
            samples = []
            for _ in range(RUNS):
                t = time.time()
                run(key)
                samples.append(time.time() - t)
            times[key] = round(statistics.median(samples), 3)
        except Exception as e:  # noqa: BLE001 - report, keep benchmarking
            errors[key] = f"{type(e).__name__}: {str(e)[:200]}"

    out = {
        "metric": "sum_of_median_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": _sf_of(SF_DIR),
        "mart_build_sec": round(mart_build, 3),
        "forecast_build_sec": round(forecast_build, 3),
        "cpus": CPUS,
        "runs": RUNS,
        "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
