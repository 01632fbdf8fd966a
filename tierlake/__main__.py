"""Command line: run the layered pipelines, diagnose the latest incident.

    python -m tierlake run dims  --raw RAW_DIR --root TABLE_DIR [--batch ID]
    python -m tierlake run facts --raw RAW_DIR --root TABLE_DIR [--batch ID]
    python -m tierlake diagnose --telemetry TELEMETRY_DIR [--top N]

RAW_DIR holds one folder of CSV files per source (brands, category,
products, customers, date, order_items). Telemetry goes to
TABLE_DIR/telemetry. The session comes from the environment
(``spark-submit`` or ``SparkSession.builder.getOrCreate()``).
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tierlake.operators import incident
from tierlake.plans.medallion import dimension_layers, fact_layers
from tierlake.plans.stages import run_layers
from tierlake.sources import events as ev

DIM_SOURCES = ("brands", "category", "products", "customers", "date")


def run(spark: SparkSession, which: str, raw_dir: str, root: str, batch_id: str | None = None,
        retries: int = 0, resume: bool = False) -> str:
    """Run the dimension or fact layers; returns the batch id. ``resume`` goes
    on with ``batch_id`` where it stopped."""
    raw_dir, root = raw_dir.rstrip("/"), root.rstrip("/")
    batch_id = batch_id or str(uuid.uuid4())
    if which == "dims":
        layers = dimension_layers(spark, {s: f"{raw_dir}/{s}/*.csv" for s in DIM_SOURCES}, root)
    elif which == "facts":
        layers = fact_layers(spark, f"{raw_dir}/order_items/*.csv", root)
    else:
        raise ValueError(f"unknown pipeline {which!r}: use 'dims' or 'facts'")
    run_layers(spark, layers, f"{root}/telemetry", batch_id, retries=retries, resume=resume)
    return batch_id


def diagnose(spark: SparkSession, telemetry: str, top: int | None = None) -> dict:
    """The latest incident and the tables upstream of it in its batch that
    carry evidence, most upstream first (all of them unless ``top`` is given:
    at most one row per table of that batch)."""
    evs = ev.read_events(spark, telemetry)
    newest = incident.batch_incidents(incident.events_with_table(evs), by=()).first()
    if newest is None:
        raise incident.NoIncidentError("no failures or anomalies found in telemetry")
    found = newest.asDict()
    batch = evs.where(F.col("batch_id") == found["batch_id"])
    evidence = incident.events_with_table(batch)
    ranked = incident.diagnose(batch, evidence, incident.batch_incidents(evidence), top)
    return {"incident": found, "root_causes": [r.asDict() for r in ranked.orderBy("rank").collect()]}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tierlake")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("pipeline", choices=["dims", "facts"])
    r.add_argument("--raw", required=True)
    r.add_argument("--root", required=True)
    r.add_argument("--batch")
    r.add_argument("--retries", type=int, default=0, help="further attempts of a failing stage")
    r.add_argument("--resume", action="store_true", help="skip what --batch has finished already")
    d = sub.add_parser("diagnose")
    d.add_argument("--telemetry", required=True)
    d.add_argument("--top", type=int, default=None, help="show only the first N causes")
    args = p.parse_args(argv)
    if args.cmd == "run" and args.resume and not args.batch:
        p.error("--resume needs --batch")
    spark = SparkSession.builder.appName("tierlake").getOrCreate()
    if args.cmd == "run":
        batch = args.batch or str(uuid.uuid4())
        try:
            run(spark, args.pipeline, args.raw, args.root, batch, args.retries, args.resume)
        except Exception as exc:  # noqa: BLE001 - the failure is already in telemetry
            print(f"run failed (batch {batch}): {exc}", file=sys.stderr)
            return 1
        print(f"batch {batch} done; telemetry in {args.root.rstrip('/')}/telemetry")
        return 0
    try:
        report = diagnose(spark, args.telemetry, args.top)
    except incident.NoIncidentError as exc:
        print(str(exc), file=sys.stderr)
        return 2
    inc = report["incident"]
    print(f"incident: {inc['incident_type']} at {inc['table']} (batch {inc['batch_id']}, "
          f"stage run {inc['stage_run_id']}, {inc['timestamp']})")
    for c in report["root_causes"]:
        print(f"  #{c['rank']} {c['node']}  depth {c['depth']}  severity {c['severity']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
