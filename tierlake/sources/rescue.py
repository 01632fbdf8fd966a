"""CSV loads that lose no row: what doesn't fit the declared schema is kept.

A plain load with a declared schema turns a value of the wrong type into NULL
and cuts or fills rows with a wrong number of fields, without a trace.
``read_csv_rescued`` parses in PERMISSIVE mode with the corrupt-record column,
so that each row that doesn't fit carries its whole line; the line is split
again as plain texts, and a cell that has a text there but no value here is
named. ``load_rescued`` stores good and rescued rows in one write (a partition
each), counted by the write itself, and sends the rescued ones with their
reason to the quarantine sink: the raw files are read once.

Reasons: ``fields`` (more or fewer fields than declared), ``values`` (a text
that isn't of the declared type; ``rescued_columns`` names them). Empty fields
are NULL and no damage; blank lines are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tierlake.sources import events as ev

LINE, REASON, COLUMNS = "rescued_line", "rescued_reason", "rescued_columns"
ALL = [LINE, REASON, COLUMNS]


def read_csv_rescued(spark: SparkSession, path: str, schema: StructType, delimiter: str = ",",
                     options: dict[str, str] | None = None) -> DataFrame:
    """The declared columns and ``ALL`` (NULL for rows that fit). Rows that
    don't fit keep the values that parsed."""
    taken = [n for n in ALL if n in schema.fieldNames()]
    if taken:
        raise ValueError(f"declared columns clash with {taken}")
    shared = {"header": "true", "delimiter": delimiter, **(options or {}), "mode": "PERMISSIVE",
              "columnNameOfCorruptRecord": LINE}
    parsed = (spark.read.schema(StructType([*schema.fields, StructField(LINE, StringType())]))
              .options(**shared).csv(path))
    texts = StructType([*(StructField(f.name, StringType()) for f in schema.fields),
                        StructField(LINE, StringType())])
    again = F.from_csv(F.col(LINE), texts.toDDL(), {k: v for k, v in shared.items() if k != "header"})
    split = parsed.withColumn("_texts", F.when(F.col(LINE).isNotNull(), again))
    lost = [F.when(F.col("_texts")[f.name].isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name))
            for f in schema.fields]
    reason = F.when(F.col(LINE).isNotNull(), F.when(F.col("_texts")[LINE].isNotNull(), "fields").otherwise("values"))
    named = F.when(reason == "values", F.array_compact(F.array(*lost)))
    return split.select(*[F.col(f"`{f.name}`") for f in schema.fields], LINE, reason.alias(REASON),
                        named.alias(COLUMNS))


@dataclass(frozen=True)
class Loaded:
    """Rows of one load; their sum is the number of raw rows."""

    good: int
    rescued: int


def load_rescued(spark: SparkSession, path: str, schema: StructType, target: str, telemetry_root: str,
                 batch_id: str, stage_run_id: str, artifact_id: str, pipeline_name: str,
                 delimiter: str = ",", options: dict[str, str] | None = None) -> Loaded:
    """Store all rows under ``target`` (partitions ``rescued=false`` and
    ``rescued=true``) and quarantine the rescued ones. A repeated load
    overwrites the target."""
    rows = read_csv_rescued(spark, path, schema, delimiter, options).withColumn(
        "rescued", F.col(LINE).isNotNull())
    seen = Observation()
    observed = rows.observe(seen, F.count_if(~F.col("rescued")).alias("good"),
                            F.count_if("rescued").alias("rescued"))
    observed.write.mode("overwrite").partitionBy("rescued").parquet(target)
    counted = Loaded(seen.get["good"], seen.get["rescued"])
    if counted.rescued:
        stored = spark.read.schema(rows.schema).parquet(target).where("rescued").drop("rescued")
        ev.quarantine(stored, telemetry_root, batch_id, stage_run_id, artifact_id, pipeline_name, path,
                      error_type="SCHEMA_MISMATCH")
    return counted


def good_rows(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of a load that fit the declared schema."""
    kept = StructType([*schema.fields, StructField("rescued", StringType())])
    return spark.read.schema(kept).parquet(target).where("rescued = 'false'").drop("rescued")
