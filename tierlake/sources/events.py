"""Telemetry events: one wide schema, stored as JSON lines partitioned by kind.

Kinds: execution, schema_drift, lineage, anomaly, validation,
quarantine_record. A stage appends all its events in one write (no file per
event); readers prune by the ``event_type`` partition. Quarantined rows are
written straight from the executors (``quarantine``), never collected.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType,
                               MapType, StringType, StructField, StructType, TimestampType)

KINDS = ("execution", "schema_drift", "lineage", "anomaly", "validation", "quarantine_record")
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Microsecond text for both timestamp kinds (the defaults keep milliseconds).
TS_OPTIONS = {"timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_FORMAT}

_S, _L = StringType(), LongType()
EVENT_FIELDS = [
    StructField("batch_id", _S), StructField("stage_run_id", _S), StructField("artifact_id", _S),
    StructField("timestamp", TimestampType()),
    StructField("pipeline_name", _S), StructField("stage_name", _S),
    # execution
    StructField("status", _S), StructField("execution_time_sec", DoubleType()),
    StructField("row_count", _L), StructField("retry_count", IntegerType()),
    # schema_drift
    StructField("expected_schema", MapType(_S, _S)), StructField("actual_schema", MapType(_S, _S)),
    StructField("missing_columns", ArrayType(_S)), StructField("extra_columns", ArrayType(_S)),
    StructField("type_changes", MapType(_S, StructType([StructField("expected", _S),
                                                         StructField("actual", _S)]))),
    # lineage
    StructField("upstream_tables", ArrayType(_S)), StructField("downstream_table", _S),
    StructField("operation", _S),
    # anomaly / validation
    StructField("anomaly_type", _S), StructField("validation_type", _S),
    StructField("failed_rows", _L), StructField("details", _S),
    # quarantine_record
    StructField("source_file", _S), StructField("error_type", _S), StructField("raw_record", _S),
    StructField("repair_attempted", BooleanType()), StructField("repair_status", _S),
]
EVENT_SCHEMA = StructType(EVENT_FIELDS)  # without the event_type partition column
FIELD_NAMES = [f.name for f in EVENT_FIELDS]


def now() -> _dt.datetime:
    return _dt.datetime.now()


def event(kind: str, batch_id: str, stage_run_id: str, artifact_id: str,
          timestamp: _dt.datetime | None = None, **fields) -> dict:
    """One event as a dict (unknown field names raise)."""
    if kind not in KINDS:
        raise ValueError(f"unknown event kind {kind!r}")
    bad = set(fields) - set(FIELD_NAMES)
    if bad:
        raise ValueError(f"unknown event fields {sorted(bad)}")
    if "details" in fields and not isinstance(fields["details"], (str, type(None))):
        fields["details"] = json.dumps(fields["details"], default=str, sort_keys=True)
    return {"event_type": kind, "batch_id": batch_id, "stage_run_id": stage_run_id,
            "artifact_id": artifact_id, "timestamp": timestamp or now(), **fields}


def events_frame(spark: SparkSession, events: list[dict]) -> DataFrame:
    schema = StructType(EVENT_FIELDS + [StructField("event_type", _S)])
    rows = [tuple(e.get(n) for n in schema.fieldNames()) for e in events]
    return spark.createDataFrame(rows, schema)


def write_events(df: DataFrame, root: str) -> None:
    """Append events (any frame with EVENT_SCHEMA columns + event_type)."""
    cols = [F.col(n) if n in df.columns else F.lit(None).cast(f.dataType).alias(n)
            for n, f in zip(FIELD_NAMES, EVENT_FIELDS)]
    (df.select(*cols, "event_type").write.mode("append").partitionBy("event_type")
       .options(**TS_OPTIONS).json(root))


def append_events(spark: SparkSession, root: str, events: list[dict]) -> None:
    """Append the events of one stage run (a few rows of the driver): one
    task, and one file for each kind among them."""
    if events:
        write_events(events_frame(spark, events).coalesce(1), root)


def exists(spark: SparkSession, path: str) -> bool:
    """Through the cluster's file system (a bare path means the default FS)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


CORRUPT = "_corrupt_record"


def _parse(text: DataFrame, fields: list[StructField] = EVENT_FIELDS) -> DataFrame:
    """``text`` (column ``value``) with the parsed event in ``_e``. Every line
    is parsed once by the whole schema, whatever a caller selects later, so
    a line is good or bad for all queries alike. Blank lines are no lines."""
    schema = StructType(fields + [StructField(CORRUPT, _S)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **TS_OPTIONS}
    return (text.where(F.trim("value") != "")
            .withColumn("_e", F.from_json("value", schema, options)))


def _good() -> Column:
    """A parsed event: no value failed and it has its timestamp."""
    return F.col(f"_e.{CORRUPT}").isNull() & F.col("_e.timestamp").isNotNull()


def _reason() -> Column:
    return (F.when(F.try_parse_json("value").isNull(), "not JSON")
            .when(F.get_json_object("value", "$.timestamp").isNull(), "no timestamp")
            .otherwise("bad value"))


def _event_lines(spark: SparkSession, root: str) -> DataFrame:
    text = spark.read.text(root)
    if "event_type" not in text.columns:  # no kind has been written yet
        text = text.withColumn("event_type", F.lit(None).cast("string"))
    return text.select("value", F.col("event_type").cast("string").alias("event_type"),
                       F.col("_metadata.file_path").alias("file_path"))


def read_events(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Events of one kind (or all). A missing folder gives an empty frame.
    Lines that are no whole event are left out: ``unreadable_events`` has
    exactly those."""
    if not exists(spark, root):
        return spark.createDataFrame([], StructType(EVENT_FIELDS + [StructField("event_type", _S)]))
    lines = _event_lines(spark, root)
    if kind is not None:
        lines = lines.where(F.col("event_type") == kind)
    return (_parse(lines).where(_good())
            .select(*[F.col(f"_e.{n}").alias(n) for n in FIELD_NAMES], "event_type"))


def stream_events(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``read_events`` as a file stream: each event once, as its file
    arrives. The folder must hold events when the stream starts."""
    reader = spark.readStream.schema("value string, event_type string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (_parse(reader.text(root)).where(_good())
            .select(*[F.col(f"_e.{n}").alias(n) for n in FIELD_NAMES], "event_type"))


def unreadable_events(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the event folder that ``read_events`` leaves out, with their
    file and the reason (``not JSON``, ``no timestamp``, ``bad value``).
    Readable and unreadable lines together are all lines but blank ones."""
    if not exists(spark, root):
        return spark.createDataFrame([], "file_path string, line string, reason string")
    return (_parse(_event_lines(spark, root)).where(~_good())
            .select("file_path", F.col("value").alias("line"), _reason().alias("reason")))


def compact_events(spark: SparkSession, src_root: str, dst_root: str,
                   rows_per_file: int = 1_000_000) -> int:
    """Rewrite an event folder (many small appends) into ``dst_root`` with
    few files: events are range-partitioned by kind and time, so a kind that
    holds nearly all events spreads over many tasks, and files hold at most
    ``rows_per_file`` rows. Unreadable lines stay behind. Returns the number
    of events written. The source is left untouched; readers switch to
    ``dst_root``."""
    if src_root.rstrip("/") == dst_root.rstrip("/"):
        raise ValueError("compact into a new folder: overwriting the source would delete it "
                         "before it is read")
    events = read_events(spark, src_root)
    n = events.count()
    if n == 0:
        return 0
    (events.repartitionByRange("event_type", "timestamp", "artifact_id").write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("event_type")
     .options(**TS_OPTIONS).json(dst_root))
    return n


# Folders of a one-file-per-event telemetry layout, per kind.
LEGACY_FOLDERS = {
    "execution": "logs/execution",
    "schema_drift": "logs/schema",
    "lineage": "logs/lineage",
    "anomaly": "logs/anomalies",
    "validation": "logs/validation",
    "quarantine_record": "quarantine",
}


def _legacy_files(spark: SparkSession, base: str) -> DataFrame | None:
    """One row per file of a one-file-per-event folder, parsed into ``_e``
    (the timestamp as text and as ``_ts``); None without any folder."""
    fields = [StructField(f.name, _S) if f.name == "timestamp" else f for f in EVENT_FIELDS]
    out = None
    for kind, folder in LEGACY_FOLDERS.items():
        path = f"{base.rstrip('/')}/{folder}"
        if exists(spark, path):
            files = spark.read.text(path, wholetext=True).select(
                "value", F.col("_metadata.file_path").alias("file_path"),
                F.lit(kind).alias("event_type"))
            out = files if out is None else out.unionByName(files)
    if out is None:
        return None
    parsed = _parse(out, fields).withColumn("_ts", F.col("_e.timestamp").try_cast("timestamp"))
    good = (F.col(f"_e.{CORRUPT}").isNull() & F.col("_e.batch_id").isNotNull()
            & F.col("_ts").isNotNull())
    return parsed.withColumn("_ok", F.coalesce(good, F.lit(False)))


def read_legacy_events(spark: SparkSession, base: str) -> DataFrame:
    """Events stored one pretty-printed JSON document per file, in one
    folder per kind under ``base`` (``LEGACY_FOLDERS``). Nested ``details``
    and ``raw_record`` objects keep their JSON text; text timestamps are
    parsed; a missing folder contributes nothing. Files without a batch id
    or a readable timestamp, or with a value of another type, are left out:
    ``unreadable_legacy_events`` has exactly those."""
    files = _legacy_files(spark, base)
    if files is None:
        return spark.createDataFrame([], StructType(EVENT_FIELDS + [StructField("event_type", _S)]))
    return files.where("_ok").select(
        *[F.col("_ts").alias(n) if n == "timestamp" else F.col(f"_e.{n}").alias(n)
          for n in FIELD_NAMES], "event_type")


def unreadable_legacy_events(spark: SparkSession, base: str) -> DataFrame:
    """Files that ``read_legacy_events`` leaves out, with the reason."""
    files = _legacy_files(spark, base)
    if files is None:
        return spark.createDataFrame([], "file_path string, reason string")
    return files.where(~F.col("_ok")).select("file_path", _reason().alias("reason"))


def import_legacy_events(spark: SparkSession, base: str, dst_root: str) -> int:
    """Copy a one-file-per-event telemetry folder into ``dst_root`` (this
    module's layout); returns the number of events."""
    events = read_legacy_events(spark, base)
    n = events.count()
    if n:
        write_events(events, dst_root)
    return n


def quarantine(bad: DataFrame, root: str, batch_id: str, stage_run_id: str, artifact_id: str,
               pipeline_name: str, source_file: str, error_type: str = "NULL_PRIMARY_KEY") -> None:
    """Write every bad row as a quarantine_record event, from the executors."""
    payload = [c for c in bad.columns if not c.startswith("_metadata")]
    rec = bad.select(
        F.lit(batch_id).alias("batch_id"), F.lit(stage_run_id).alias("stage_run_id"),
        F.lit(artifact_id).alias("artifact_id"), F.current_timestamp().alias("timestamp"),
        F.lit(pipeline_name).alias("pipeline_name"), F.lit(source_file).alias("source_file"),
        F.lit(error_type).alias("error_type"),
        F.to_json(F.struct(*[F.col(c) for c in payload])).alias("raw_record"),
        F.lit(False).alias("repair_attempted"), F.lit("NOT_ATTEMPTED").alias("repair_status"),
        F.lit("quarantine_record").alias("event_type"),
    )
    write_events(rec, root)
