"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (no collect to the
driver), warmed up once, then timed ``$BENCH_RUNS`` times; the median is
reported. Also times the quality checks of the order-item pipeline two ways
on the same session: one job per check (how an unfused wrapper runs them)
and the fused single pass.

Prints one JSON line:
{"metric": "headline_total_median_sec", "value": N, "unit": "sec",
 "queries": {...}, "sf": ..., ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tierlake.operators import quality  # noqa: E402
from tierlake.plans import catalog, registry  # noqa: E402
from tierlake.session import local_session  # noqa: E402

HEADLINE = [
    "fact_clean", "fact_mart", "dq_report", "dq_duplicate_keys", "dedupe_composite",
    "dedupe_single", "product_dim", "region_lookup", "date_dim", "units_clean",
    "incident_choice", "stage_context", "lineage_closure", "root_cause_rank",
    "rules_basic", "rules_zscore",
]


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs: int, warmup: bool = True) -> float:
    if warmup:
        fn()
    ts = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t0)
    return statistics.median(ts)


def per_check_jobs(df, checks: quality.Checks) -> None:
    """One Spark job per check, each recomputing the plan (unfused)."""
    df.count()
    if checks.keys:
        df.where(quality.any_null(list(checks.keys))).count()
        df.groupBy(*checks.keys).count().where(F.col("count") > 1).count()
    for c in (*checks.critical, *checks.metrics):
        df.where(F.col(c).isNull()).count()
    for c in quality._numeric_metrics(df, checks):
        df.where(F.col(c) < 0).count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")))
    spark.sparkContext.setLogLevel("ERROR")

    # Session warm-up (JIT, first-use class loading) outside the timings.
    force(catalog.fact_mart(spark, os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")))

    results: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for name in names:
        q = registry.QUERIES[name]
        try:
            results[name] = round(timed(lambda: force(q(spark, sf_dir)), runs), 3)
        except Exception as exc:  # noqa: BLE001 - report and keep timing the rest
            results[name], errors[name] = None, f"{type(exc).__name__}: {str(exc)[:200]}"

    silver = catalog.fact_clean(spark, sf_dir)
    gold = catalog.fact_mart(spark, sf_dir)
    # fused pass gets a warm-up; the slow unfused path runs on the already
    # warm session (the headline queries ran the same plans).
    fused_runs = int(os.environ.get("BENCH_FUSED_RUNS", "5"))
    unfused_runs = int(os.environ.get("BENCH_UNFUSED_RUNS", "5"))
    checks_fused = timed(lambda: (quality.profile(silver, catalog.SILVER_ITEM_CHECKS).collect(),
                                  quality.profile(gold, catalog.GOLD_ITEM_CHECKS).collect()),
                         fused_runs)
    checks_unfused = timed(lambda: (per_check_jobs(silver, catalog.SILVER_ITEM_CHECKS),
                                    per_check_jobs(gold, catalog.GOLD_ITEM_CHECKS)), unfused_runs,
                           warmup=False)
    results["checks_per_job"] = round(checks_unfused, 3)
    results["checks_fused"] = round(checks_fused, 3)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "headline_total_median_sec",
        "value": round(sum(results[n] or 0.0 for n in names), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "fused_check_speedup": round(checks_unfused / checks_fused, 2) if checks_fused else None,
        "check_runs": {"fused": fused_runs, "per_job": unfused_runs},
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
