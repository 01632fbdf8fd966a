"""Incidents kept up to date by a stream over the telemetry folder.

``keep_incidents`` reads the events that arrived since its last run and keeps
the newest failure and the newest anomaly of each group (a batch, by default)
in the state of a streaming aggregation. "Newest" is the maximum of (timestamp,
ids), which doesn't depend on the order or the split of the events: an event
that comes late, or twice, leaves the same state. Each task sends one row a
group, whatever share of the events a group has.

Groups that changed are written to ``update=<micro-batch>`` with overwrite, so
a micro-batch that is replayed replaces its own rows. A group's values only
ever grow, so its state is the maximum over its updates
(``current_incidents``). The state has one row a group and no event is ever
too late for it; it isn't evicted.

Defined results: events without a timestamp and unreadable lines are left out
(``events.unreadable_events`` reports them); NULL in a group column is a group;
ties go to the largest stage_run_id, then artifact_id (NULL is least); a
failure counts only if it is strictly newer than the anomaly; no events give
no rows. Further fields of the events aren't carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tierlake.operators.incident import ANOMALY, FAILURE
from tierlake.sources import events as ev

#: What is kept of an event, in the order that decides which is newest.
KEPT = ("timestamp", "stage_run_id", "artifact_id")


def _newest(which: Column) -> Column:
    return F.max(F.when(which, F.struct(*KEPT)))


def newest_events(events: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """by..., failure, anomaly (structs of ``KEPT``) of a frame or a stream of
    events; groups without either come out with two NULLs."""
    failed = (F.col("event_type") == "execution") & (F.col("status") == "FAILED")
    return events.groupBy(*by).agg(_newest(failed).alias(FAILURE),
                                   _newest(F.col("event_type") == "anomaly").alias(ANOMALY))


def keep_incidents(spark: SparkSession, telemetry_root: str, target_dir: str, checkpoint_dir: str,
                   by: Sequence[str] = ("batch_id",), max_files_per_trigger: int | None = None) -> int:
    """Bring the incidents under ``target_dir`` up to date with every event
    file that arrived, then stop. Returns the number of micro-batches run."""
    ran: list[int] = []

    def store(changed: DataFrame, batch_id: int) -> None:
        found = changed.where(F.col(FAILURE).isNotNull() | F.col(ANOMALY).isNotNull())
        found.write.mode("overwrite").parquet(f"{target_dir.rstrip('/')}/update={batch_id}")
        ran.append(batch_id)

    events = ev.stream_events(spark, telemetry_root, max_files_per_trigger)
    query = (newest_events(events, by).writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    query.awaitTermination()
    return len(ran)


def current_incidents(spark: SparkSession, target_dir: str, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """The incident of each group as of the last update: by...,
    incident_type, and the fields ``KEPT``."""
    field = {f.name: f for f in [*ev.EVENT_FIELDS, StructField("event_type", StringType())]}
    kept = StructType([field[c] for c in KEPT])
    schema = StructType([*(field[c] for c in by), StructField(FAILURE, kept), StructField(ANOMALY, kept)])
    updates = (spark.read.schema(schema).parquet(target_dir) if ev.exists(spark, target_dir)
               else spark.createDataFrame([], schema))
    newest = updates.groupBy(*by).agg(F.max(FAILURE).alias(FAILURE), F.max(ANOMALY).alias(ANOMALY))
    failure, anomaly = F.col(FAILURE), F.col(ANOMALY)
    wins = anomaly.isNull() | (failure["timestamp"] > anomaly["timestamp"])
    is_failure = failure.isNotNull() & wins
    return newest.select(*by, F.when(is_failure, FAILURE).otherwise(ANOMALY).alias("incident_type"),
                         *[F.when(is_failure, failure[c]).otherwise(anomaly[c]).alias(c) for c in KEPT])
