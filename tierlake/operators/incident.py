"""Incident analysis over telemetry, as DataFrame queries.

* ``latest``            newest row (per group), ties broken by ids
* ``incident_choice``   failure only when strictly newer than the anomaly
* ``stage_context``     the evidence events of one stage run
* ``stage_summary``     per run: counts per kind, first and last timestamp
* ``lineage_record``    an incident's own lineage record (first match)
* ``direct_upstream``   lineage records producing an incident's inputs
* ``lineage_edges``     (batch_id, child, parent) edges from lineage events
* ``lineage_closure``   all ancestors with least depth (frontier loop)
* ``rank_root_causes``  ancestors with evidence, most upstream first
* ``diagnose``          incident, upstream tables and evidence of each batch, ranked

Everything is an aggregate, join or anti-join: hot groups are combined
map-side, and no group is ever collected into one task or the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tierlake.operators.dedupe import dedupe, order_columns
from tierlake.session import scratch_path

FAILURE, ANOMALY = "failure", "anomaly"
# Evidence severity for ranking: a failure outranks an anomaly outranks drift.
SEVERITY = {"failure": 3, "anomaly": 2, "drift": 1}


# Ids that settle ties between rows of one timestamp, where a frame has them.
TIE_IDS = ("stage_run_id", "artifact_id", "event_id")


def latest(df: DataFrame, ts: str = "timestamp", by: Sequence[str] = (),
           tie: Sequence[str] = ()) -> DataFrame:
    """Newest row per group (or overall). Ties on ``ts`` go to the largest
    ``tie`` columns, then the largest ids (``TIE_IDS``); a frame without any
    of those ids is ordered by all its other columns. Event frames with maps
    work: only named columns are sorted. An empty input gives no row."""
    by = list(by)
    order = [ts, *[c for c in tie if c not in by and c != ts]]
    ids = [c for c in TIE_IDS if c in df.columns and c not in by and c not in order]
    if not by:
        # Distributed top-1: each task keeps its best row, then one merge.
        cols = order_columns(df, [], order + ids, descending=True, rest=not ids)
        return df.orderBy(*cols).limit(1)
    # row_number() = 1 per group: planned with a map-side WindowGroupLimit,
    # so a hot group sends one row per map task through the shuffle.
    return dedupe(df, by, order_by=order + ids, descending=True, rest=not ids)


def latest_failure(executions: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Newest FAILED execution."""
    return latest(executions.where(F.col("status") == "FAILED"), ts, by)


def latest_anomaly(anomalies: DataFrame, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """R2: newest anomaly."""
    return latest(anomalies, ts, by)


def incident_choice(failures: DataFrame, anomalies: DataFrame, by: Sequence[str] = (),
                    ts: str = "timestamp", cols: Sequence[str] = ()) -> DataFrame:
    """The incident per group: the newest failure if strictly newer than
    the newest anomaly, else the newest anomaly (a tie goes to the anomaly).

    ``cols`` are carried from both sides. Output: by..., incident_type, ts,
    cols... An empty input (no failure, no anomaly) gives no row for that
    group; callers treat that as 'nothing to investigate'.
    """
    keep = [*by, ts, *cols]
    cand = (failures.select(*keep, F.lit(0).alias("_prio"), F.lit(FAILURE).alias("incident_type"))
            .unionByName(anomalies.select(*keep, F.lit(1).alias("_prio"),
                                          F.lit(ANOMALY).alias("incident_type"))))
    pick = latest(cand, ts, by, tie=["_prio"])
    return pick.select(*by, "incident_type", ts, *cols)


class NoIncidentError(LookupError):
    """Neither a failure nor an anomaly was recorded."""


def find_incident(failures: DataFrame, anomalies: DataFrame, ts: str = "timestamp",
                  cols: Sequence[str] = ("batch_id", "stage_run_id", "artifact_id")) -> dict:
    """The single newest incident over all telemetry (R3), as a dict with
    ``incident_type``; raises ``NoIncidentError`` when there is none. Only
    the one winning row reaches the driver."""
    row = incident_choice(failures, anomalies, ts=ts, cols=cols).first()
    if row is None:
        raise NoIncidentError("no failures or anomalies found in telemetry")
    return row.asDict()


def stage_context(events: DataFrame, stage_run_id: str,
                  kinds: Sequence[str] = ("execution", "schema_drift", "anomaly", "lineage")) -> DataFrame:
    """The evidence events of one stage run (quarantine and validation
    events are not evidence)."""
    return events.where((F.col("stage_run_id") == stage_run_id)
                        & F.col("event_type").isin(*kinds))


def stage_summary(events: DataFrame, run: str = "stage_run_id", kind: str = "event_type",
                  kinds: Sequence[str] = ("execution", "schema_drift", "anomaly", "lineage"),
                  ts: str = "timestamp") -> DataFrame:
    """Per run: one count per kind, first and last timestamp (one shuffle)."""
    return events.groupBy(run).agg(
        *[F.count_if(F.col(kind) == k).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )


def lineage_record(incidents: DataFrame, lineage: DataFrame,
                   keys: Sequence[str] = ("stage_run_id", "artifact_id")) -> DataFrame:
    """Each incident with its own lineage record (left join; the first
    record per key when several exist)."""
    keys = list(keys)
    first = _first_per_key(lineage, keys)
    return incidents.join(first, keys, "left")


def _first_per_key(lineage: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in ("downstream_table", "upstream_tables", "operation") if c in lineage.columns]
    return dedupe(lineage.select(*keys, *cols), keys, order_by=cols)


def lineage_edges(lineage: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch_id, child, parent) table-level edges from lineage events."""
    return (lineage.select(F.col(batch).alias("batch_id"),
                           F.col("downstream_table").alias("child"),
                           F.explode("upstream_tables").alias("parent"))
            .distinct())


def direct_upstream(incidents: DataFrame, lineage: DataFrame, table_col: str = "table",
                    batch: str = "batch_id") -> DataFrame:
    """Lineage records (same batch) whose output is one of the
    incident table's inputs."""
    edges = lineage_edges(lineage, batch)
    inc = incidents.select(F.col(batch).alias("batch_id"), F.col(table_col).alias("child"))
    ups = inc.join(edges, ["batch_id", "child"]).select("batch_id", "child", "parent")
    producers = lineage.select(F.col(batch).alias("batch_id"),
                               F.col("downstream_table").alias("parent"),
                               "stage_run_id", "artifact_id", "upstream_tables", "operation")
    return ups.join(producers, ["batch_id", "parent"])


HOPS_PER_ROUND = 8  # levels walked by one job of the closure


def lineage_closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None,
                    group: Sequence[str] = (), node: str = "node", child: str = "child",
                    parent: str = "parent") -> DataFrame:
    """Every ancestor reachable from ``starts`` within ``group`` (e.g.
    the batch, or the start node itself for per-incident closures), with
    its least depth. Start nodes are included at depth 0; NULL parents are
    no nodes.

    The walk goes on until no new node appears. A ``max_depth`` is the
    caller's choice, and the result then has a boolean column ``truncated``
    (on every row) that tells whether deeper ancestors were left out.

    One job walks ``HOPS_PER_ROUND`` levels from the deepest nodes known,
    keeps the least depth of each node that was not reached before, and
    appends them to one table in the shared scratch folder. A node is new at
    its true depth, because every shortest path crosses the level the round
    started from; cycles and diamonds end since reached nodes are dropped.
    The edges are stored unpartitioned, so each join shuffles or broadcasts
    by run-time sizes and AQE can split a child with very many parents. The
    result is one scan, whatever the depth.
    """
    spark = edges.sparkSession
    group = list(group)
    keys = [*group, node]
    edge_groups = [g for g in group if g in edges.columns]
    root = scratch_path(spark, "closure")
    (edges.where(F.col(parent).isNotNull())
     .select(*edge_groups, F.col(child).alias("_child"), F.col(parent).alias("_parent"))
     .write.parquet(f"{root}/edges"))
    e = spark.read.parquet(f"{root}/edges")

    # Rows keep the hop inside their round, so every round runs the same
    # generated code: depth = (round - 1) * HOPS_PER_ROUND + hop.
    first = starts.select(*keys).distinct().withColumn("hop", F.lit(HOPS_PER_ROUND))
    first.write.parquet(f"{root}/reached/round=0")
    fields = first.schema.fields
    stored = StructType([*fields, StructField("round", IntegerType())])
    rounds = 0
    while max_depth is None or rounds * HOPS_PER_ROUND <= max_depth:
        reached = spark.read.schema(stored).parquet(f"{root}/reached").select(*keys)
        found = (spark.read.schema(StructType(fields)).parquet(f"{root}/reached/round={rounds}")
                 .where(F.col("hop") == HOPS_PER_ROUND).withColumn("hop", F.lit(0)))
        for hop in range(HOPS_PER_ROUND):
            # Rows of the last level meet their edges; earlier ones pass as they are.
            on = [F.col(f"f.{g}") == F.col(f"e.{g}") for g in edge_groups]
            on += [F.col(f"f.{node}") == F.col("e._child"), F.col("f.hop") == hop]
            here = F.struct(F.col(f"f.{node}").alias(node), F.col("f.hop").alias("hop"))
            up = F.struct(F.col("e._parent").alias(node), (F.col("f.hop") + 1).alias("hop"))
            both = F.array_compact(F.array(here, F.when(F.col("e._parent").isNotNull(), up)))
            found = (found.alias("f").join(e.alias("e"), on, "left")
                     .select(*[F.col(f"f.{g}").alias(g) for g in group],
                             F.explode(both).alias("_n"))
                     .groupBy(*group, F.col(f"_n.{node}").alias(node))
                     .agg(F.min("_n.hop").alias("hop")))
        rounds += 1
        obs = Observation()
        (found.join(reached, keys, "left_anti")
         .observe(obs, F.count_if(F.col("hop") == HOPS_PER_ROUND).alias("deepest"))
         .write.parquet(f"{root}/reached/round={rounds}"))
        if not obs.get["deepest"]:
            break
    depth = ((F.col("round") - 1) * HOPS_PER_ROUND + F.col("hop")).cast("int")
    out = (spark.read.schema(stored).parquet(f"{root}/reached")
           .select(*keys, depth.alias("depth")))
    if max_depth is None:
        return out
    beyond = not out.where(F.col("depth") > max_depth).isEmpty()
    return out.where(F.col("depth") <= max_depth).withColumn("truncated", F.lit(beyond))


def evidence_severity(failure: Column, anomaly: Column, drift: Column) -> Column:
    return (F.when(failure, F.lit(SEVERITY["failure"]))
            .when(anomaly, F.lit(SEVERITY["anomaly"]))
            .when(drift, F.lit(SEVERITY["drift"])))


def rank_root_causes(closure: DataFrame, evidence: DataFrame, group: Sequence[str] = (),
                     node: str = "node", ts: str | None = None,
                     top: int | None = None) -> DataFrame:
    """Ancestors that carry evidence, ranked most upstream first, then
    failure > anomaly > drift, then earliest ``ts`` (then node id).

    ``evidence`` has (node, severity[, ts]) with severity from
    ``evidence_severity``, and matches on those ``group`` columns it has as
    well. The rank restarts per group; column ``rank`` is always there. All
    are ranked unless the caller names a ``top``.

    The full ranking splits each group by depth and severity, the leading
    sort columns: rows are numbered inside such a part, and the sizes of the
    parts before it are added. One group is never sorted in one task alone.
    """
    group = list(group)
    on = [*[g for g in group if g in evidence.columns], node]
    cand = closure.join(evidence, on).where(F.col("severity").isNotNull())
    ties = [*([F.col(ts).asc_nulls_last()] if ts else []), F.col(node).asc()]
    order = [F.col("depth").desc(), F.col("severity").desc()]
    if top is not None:
        if not group:
            cand = cand.orderBy(*order, *ties).limit(top)
        w = Window.partitionBy(*group).orderBy(*order, *ties)
        return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    part = [*group, "depth", "severity"]
    before = (Window.partitionBy(*group).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    sizes = (cand.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inner = F.row_number().over(Window.partitionBy(*part).orderBy(*ties))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"s.{c}")) for c in part]
    return (cand.withColumn("_inner", inner).alias("c").join(sizes.alias("s"), same)
            .select("c.*", (F.col("_before") + F.col("_inner")).cast("int").alias("rank"))
            .drop("_inner"))


def events_with_table(events: DataFrame) -> DataFrame:
    """Failures, anomalies and drifts of event rows with the table their
    stage run was writing (from its lineage event; NULL without one), the
    ids, the time, and the severity of this kind of evidence."""
    kind = F.col("event_type")
    lineage = (events.where(kind == "lineage")
               .select("batch_id", "artifact_id", F.col("downstream_table").alias("table"))
               .distinct())
    found = events.select(
        "batch_id", "stage_run_id", "artifact_id", "timestamp",
        evidence_severity((kind == "execution") & (F.col("status") == "FAILED"),
                          kind == "anomaly", kind == "schema_drift").alias("severity"))
    return (found.where(F.col("severity").isNotNull())
            .join(lineage, ["batch_id", "artifact_id"], "left"))


def batch_incidents(evidence: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """R3 over ``events_with_table`` rows: the incident of each batch, or the
    newest of all with ``by=()``."""
    cols = [c for c in ("batch_id", "stage_run_id", "artifact_id", "table") if c not in by]
    return incident_choice(evidence.where(F.col("severity") == SEVERITY["failure"]),
                           evidence.where(F.col("severity") == SEVERITY["anomaly"]),
                           by=by, cols=cols)


def diagnose(events: DataFrame, evidence: DataFrame, incidents: DataFrame,
             top: int | None = None) -> DataFrame:
    """R3 -> R6 -> R7: for each incident (one per batch), the tables upstream
    of it in its own batch that carry evidence of that batch, ranked. Tables
    of one depth and severity go by their earliest evidence."""
    lineage = events.where(F.col("event_type") == "lineage")
    closure = lineage_closure(lineage_edges(lineage),
                              incidents.select("batch_id", F.col("table").alias("node")),
                              group=["batch_id"])
    per_table = (evidence.groupBy("batch_id", F.col("table").alias("node"))
                 .agg(F.max("severity").alias("severity"), F.min("timestamp").alias("first_ts")))
    ranked = rank_root_causes(closure, per_table, group=["batch_id"], ts="first_ts", top=top)
    return ranked.join(incidents.select("batch_id", "incident_type",
                                        F.col("table").alias("incident_table")), "batch_id")
