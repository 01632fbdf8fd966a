"""Observed stage runs: write a table, check it once, record telemetry.

``run_stage`` does, for one table of one layer:

1. bronze only: discovery read of the raw files and schema diff against
   the declared schema (``schema_drift`` event when they differ);
2. build the DataFrame and write it to a staging folder, then swap it into
   place (so a stage may rebuild the table it reads, and a failed write
   leaves the old table whole); the un-keyed check metrics ride along on
   the write through ``DataFrame.observe``: no extra scan;
3. with a key or validation rules: one pass over the *stored* table (null
   and duplicate keys, per-column nulls, one violation count per rule) --
   at most a single shuffle on the key;
4. one ``anomaly`` event per violated check; bronze writes every row with a
   NULL key to quarantine from the executors;
5. ``lineage``, one ``validation`` per rule, and ``execution`` (SUCCESS,
   seconds, rows) events.

On any error: ``anomaly`` PIPELINE_FAILURE, ``execution`` FAILED (0 rows)
and ``lineage`` are appended in that order, then the original exception is
re-raised (a failing event write is attached as a note, never masking it).

All events of a stage run go out in one append.

A stage may be tried again (``retries``): an attempt that isn't the last
leaves one ``execution`` event RETRYING with its error, and the final event
carries the number of retries that were needed. ``run_layers(resume=True)``
goes on with a batch from its telemetry: tables whose latest run in the batch
succeeded after all they read are left as they are.
"""

from __future__ import annotations

import datetime as dt
import time
import traceback
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierlake.operators import drift, quality, rules as rules_mod
from tierlake.operators.incident import latest
from tierlake.operators.quality import Checks
from tierlake.sources import events as ev
from tierlake.sources.ingest import infer_schema, swap_into

OPERATIONS = {"bronze": "raw_to_bronze_load", "silver": "bronze_to_silver_transformation",
              "gold": "silver_to_gold_aggregation"}


@dataclass
class StageSpec:
    """One table load.

    build      () -> DataFrame to store (lazy; nothing runs until the write)
    target     logical table name (used in lineage)
    path       where the table's files go (a shared folder)
    upstream   logical names (or the raw path) this table reads
    """

    pipeline_name: str
    target: str
    path: str
    build: Callable[[], DataFrame]
    upstream: Sequence[str]
    checks: Checks = field(default_factory=Checks)
    rules: Sequence[rules_mod.Rule] = ()
    source_path: str | None = None
    expected_schema: StructType | None = None
    delimiter: str = ","
    fmt: str = "parquet"
    # Share of raw rows CSV inference reads for the drift check (1.0: all,
    # as a full discovery scan; lower it on very large raw inputs).
    inference_sampling_ratio: float = 1.0


def _tick(last: list[dt.datetime]) -> dt.datetime:
    """Strictly increasing event timestamps within one stage run."""
    t = ev.now()
    if last and t <= last[-1]:
        t = last[-1] + dt.timedelta(microseconds=1)
    last.append(t)
    return t


def run_stage(spark: SparkSession, spec: StageSpec, telemetry_root: str, batch_id: str,
              stage_run_id: str, retries: int = 0, wait_sec: float = 0.0) -> dict:
    """Run one observed table load; returns {'status', 'row_count', 'findings'}.
    After an error it is tried again up to ``retries`` times, with a pause of
    ``wait_sec`` that doubles each time. Each attempt is an artifact of its
    own, builds its DataFrame anew and swaps a finished table into place, so
    a broken one leaves nothing behind in it."""
    for attempt in range(retries):
        try:
            return _attempt(spark, spec, telemetry_root, batch_id, stage_run_id, attempt, last=False)
        except Exception:  # noqa: BLE001 - recorded by the attempt
            time.sleep(wait_sec * 2**attempt)
    return _attempt(spark, spec, telemetry_root, batch_id, stage_run_id, retries, last=True)


def _attempt(spark: SparkSession, spec: StageSpec, telemetry_root: str, batch_id: str,
             stage_run_id: str, retry_count: int, last: bool) -> dict:
    stage = spec.checks.stage
    artifact_id = str(uuid.uuid4())
    ids = dict(batch_id=batch_id, stage_run_id=stage_run_id, artifact_id=artifact_id)
    common = dict(pipeline_name=spec.pipeline_name, stage_name=stage)
    lineage = dict(upstream_tables=list(spec.upstream), downstream_table=spec.target,
                   operation=OPERATIONS.get(stage, stage))
    ts: list[dt.datetime] = []
    out: list[dict] = []
    t0 = time.time()
    try:
        if stage == "bronze" and spec.expected_schema is not None and spec.source_path:
            actual = infer_schema(spark, spec.source_path, spec.delimiter,
                                  spec.inference_sampling_ratio)
            diff = drift.schema_diff(spec.expected_schema, actual)
            if diff:
                exp = {f.name: drift.type_name(f.dataType) for f in spec.expected_schema.fields}
                act = {f.name: drift.type_name(f.dataType) for f in actual.fields}
                out.append(ev.event(
                    "schema_drift", **ids, timestamp=_tick(ts), **common,
                    expected_schema=exp, actual_schema=act,
                    missing_columns=[r[0] for r in diff if r[1] == "missing"],
                    extra_columns=[r[0] for r in diff if r[1] == "extra"],
                    type_changes={r[0]: (r[2], r[3]) for r in diff if r[1] == "type_change"}))

        df = spec.build()
        obs = Observation(f"checks_{artifact_id.replace('-', '')}")
        observed = df.observe(obs, *quality.row_metrics(df, spec.checks))
        staging = f"{spec.path.rstrip('/')}.__staging_{artifact_id}"
        observed.write.format(spec.fmt).mode("overwrite").save(staging)
        metrics = dict(obs.get)
        swap_into(spark, staging, spec.path)  # the plan may read spec.path itself

        stored = spark.read.format(spec.fmt).load(spec.path)
        numeric = quality._numeric_metrics(stored, spec.checks)
        if spec.rules or (spec.checks.keys and spec.checks.duplicate_check):
            # one pass over the stored table: keyed checks and rule counts
            extra = rules_mod.rule_metrics(stored, list(spec.rules)) if spec.rules else None
            metrics = quality.profile(stored, spec.checks, extra).first().asDict()
        found = quality.findings_from_values(spark, metrics, spec.checks, numeric,
                                             spec.target).collect()  # <= one row per check
        for f in found:
            if stage == "bronze" and f["check"] == "NULL_PRIMARY_KEY":
                continue  # bronze rows without a key go to quarantine instead
            out.append(ev.event(
                "anomaly", **ids, timestamp=_tick(ts), **common, anomaly_type=f["check"],
                failed_rows=f["failed_rows"],
                details={"column_name": f["column_name"], "failed_rows": f["failed_rows"],
                         "expected": f["expected"], "actual": f["actual"],
                         "table": spec.target}))
        if stage == "bronze" and spec.checks.keys and metrics.get("null_key_rows", 0) > 0:
            ev.quarantine(quality.bad_rows(stored, spec.checks.keys), telemetry_root,
                          batch_id, stage_run_id, artifact_id, spec.pipeline_name,
                          spec.source_path or spec.target)

        rows = int(metrics["row_count"])
        for res in rules_mod.results_from_counts(list(spec.rules), metrics, rows):
            out.append(ev.event(
                "validation", **ids, timestamp=_tick(ts), **common,
                validation_type=res["rule_type"], status=res["status"],
                failed_rows=res["failed_rows"],
                details={k: res[k] for k in ("rule_id", "column_name", "severity", "total_rows",
                                             "table_name")}))
        out.append(ev.event("lineage", **ids, timestamp=_tick(ts), **lineage))
        out.append(ev.event("execution", **ids, timestamp=_tick(ts), **common, status="SUCCESS",
                            execution_time_sec=round(time.time() - t0, 2), row_count=rows,
                            retry_count=retry_count))
        ev.append_events(spark, telemetry_root, out)
        return {"status": "SUCCESS", "row_count": rows, "findings": [f.asDict() for f in found]}
    except Exception as exc:
        details = {"error": "".join(traceback.format_exception(exc))}
        ended = dict(execution_time_sec=round(time.time() - t0, 2), row_count=0, retry_count=retry_count)
        if last:
            out += [
                ev.event("anomaly", **ids, timestamp=_tick(ts), **common,
                         anomaly_type="PIPELINE_FAILURE", details=details),
                ev.event("execution", **ids, timestamp=_tick(ts), **common, status="FAILED", **ended),
                ev.event("lineage", **ids, timestamp=_tick(ts), **lineage),
            ]
        else:  # what the attempt found is found again by the next one
            out = [ev.event("execution", **ids, timestamp=_tick(ts), **common, status="RETRYING",
                            details=details, **ended)]
        try:
            ev.append_events(spark, telemetry_root, out)
        except Exception as write_exc:  # noqa: BLE001
            exc.add_note(f"telemetry write failed too: {write_exc!r}")
        raise


def table_states(events: DataFrame, batch_id: str) -> DataFrame:
    """Per table that a batch ran: ``downstream_table``, ``status``,
    ``timestamp`` and ``retry_count`` of its latest finished run (SUCCESS or
    FAILED). Runs meet their lineage event by artifact."""
    own = events.where(F.col("batch_id") == batch_id)
    ran = own.where((F.col("event_type") == "execution") & F.col("status").isin("SUCCESS", "FAILED"))
    made = own.where(F.col("event_type") == "lineage").select("artifact_id", "downstream_table").distinct()
    states = ran.select("artifact_id", "status", "timestamp", "retry_count").join(made, "artifact_id")
    return latest(states, by=["downstream_table"]).select(
        "downstream_table", "status", "timestamp", "retry_count")


def run_layers(spark: SparkSession, layers: dict[str, list[StageSpec]], telemetry_root: str,
               batch_id: str | None = None, retries: int = 0, wait_sec: float = 0.0,
               resume: bool = False) -> dict[str, str]:
    """Bronze, silver, gold in order; one stage_run_id per layer shared by its
    tables; stops at the first failure (the exception propagates).

    ``resume`` goes on with ``batch_id``: a table is skipped if its latest run
    in the batch succeeded, none of the tables it reads has run later, and
    none is run again now. Skipped tables are neither read nor written and
    leave no event; a layer without work gets no stage_run_id."""
    if resume and not batch_id:
        raise ValueError("resume needs the batch_id to go on with")
    batch_id = batch_id or str(uuid.uuid4())
    specs = [spec for layer in layers.values() for spec in layer]
    done: dict[str, dt.datetime] = {}
    if resume:
        states = table_states(ev.read_events(spark, telemetry_root), batch_id).where(
            (F.col("status") == "SUCCESS") & F.col("downstream_table").isin([s.target for s in specs]))
        done = {r.downstream_table: r.timestamp for r in states.collect()}  # <= one row per spec
    targets = {spec.target for spec in specs}
    runs: dict[str, str] = {}
    for layer in ("bronze", "silver", "gold"):
        for spec in layers.get(layer, ()):
            read = [t for t in spec.upstream if t in targets and t != spec.target]
            if spec.target in done and all(t in done and done[t] <= done[spec.target] for t in read):
                continue
            done.pop(spec.target, None)  # what reads this table is stale from here on
            runs.setdefault(layer, str(uuid.uuid4()))
            run_stage(spark, spec, telemetry_root, batch_id, runs[layer], retries, wait_sec)
    return runs
