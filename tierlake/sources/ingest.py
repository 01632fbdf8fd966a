"""Raw-file sources and table sinks (bronze loads).

* ``read_csv``      CSV with a declared schema (bound by position, like Spark's
                    default, or by header name with ``bind="name"``)
* ``infer_schema``  discovery read used for drift detection
* ``with_audit``    source file path and ingest time columns
* ``write_table``   full-overwrite table sink, optionally at an explicit path
* ``table_name``    layer-qualified naming from a table key
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LAYERS = ("bronze", "silver", "gold")


def read_csv(spark: SparkSession, path: str, schema: StructType, delimiter: str = ",",
             header: bool = True, bind: str = "position") -> DataFrame:
    """Scan CSV with a declared schema.

    ``bind="position"`` is Spark's default: the header is skipped and columns
    bind by position (a reordered file loads swapped columns; the drift check
    compares names to catch that). ``bind="name"`` reads the header names
    and conforms them to the schema by name (missing -> NULL, extra dropped,
    types parsed leniently).
    """
    reader = spark.read.option("header", header).option("delimiter", delimiter)
    if bind == "position":
        return reader.schema(schema).csv(path)
    if bind != "name":
        raise ValueError(f"bind must be 'position' or 'name', not {bind!r}")
    from tierlake.operators.drift import EvolutionRules, conform
    raw = reader.csv(path)  # all columns as strings, named by the header
    rules = EvolutionRules(allow_new_columns=False, allow_missing_columns=True,
                           auto_cast_types=True, strict_mode=False)
    return conform(raw, schema, rules)


def infer_schema(spark: SparkSession, path: str, delimiter: str = ",",
                 sampling_ratio: float = 1.0) -> StructType:
    """Schema as CSV inference sees it (the drift 'actual' schema).

    Inference is a full scan by default; ``sampling_ratio`` < 1 bounds it on
    very large inputs (the data itself is never sampled).
    """
    return (spark.read.option("header", True).option("delimiter", delimiter)
            .option("inferSchema", True).option("samplingRatio", sampling_ratio)
            .csv(path).schema)


def with_audit(df: DataFrame, file_col: str = "_source_file",
               time_col: str = "_ingested_at", time_first: bool = True) -> DataFrame:
    """Add the source file path (from ``_metadata``) and the ingest time."""
    cols = {time_col: F.current_timestamp(), file_col: F.col("_metadata.file_path")}
    order = [time_col, file_col] if time_first else [file_col, time_col]
    return df.select("*", *[cols[c].alias(c) for c in order])


def write_table(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite",
                path: str | None = None, partition_by: list[str] | None = None) -> None:
    """Store ``df`` as a catalog table (full overwrite by default).

    With ``path`` the table is external at that location (use a shared
    folder on a cluster). An overwrite at a path goes through a staging
    folder that is swapped in after the write succeeded, so the plan may
    read the old table and a failed write keeps it whole.
    """
    if path and mode == "overwrite":
        spark = df.sparkSession
        staging = f"{path.rstrip('/')}.__staging_{uuid.uuid4().hex}"
        w = df.write.format(fmt).mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(staging)
        swap_into(spark, staging, path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay
        parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(f"CREATE TABLE {name} USING {fmt}{parts} LOCATION '{path}'")
        if partition_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")
        return
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def swap_into(spark: SparkSession, staging: str, path: str) -> None:
    """Replace the folder ``path`` with the fully written ``staging`` folder.

    Writing to a staging folder first means a plan may read the table it
    replaces (a plain overwrite deletes it before reading it) and a failed
    write leaves the old table whole. The old folder is moved aside, the new
    one takes its name, and only then is the old one deleted; if the second
    move fails, the old folder is moved back.
    """
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.__old_{uuid.uuid4().hex}")
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parent = dst.getParent()
    if parent is not None and not fs.exists(parent):
        fs.mkdirs(parent)
    had = fs.exists(dst)
    if had and not fs.rename(dst, old):
        raise OSError(f"could not move {path} aside")
    try:
        moved = fs.rename(src, dst)
    except Exception:
        moved = False
    if not moved:
        if had:
            fs.rename(old, dst)
        raise OSError(f"could not move {staging} to {path}; the old table is kept")
    if had:
        fs.delete(old, True)


def table_name(key: str, catalog: str | None = None, names: dict[str, str] | None = None) -> str:
    """Layer-qualified name from a key: 'slv_' -> silver, 'gld_' -> gold,
    otherwise bronze. With a catalog the 3-part name drops the prefix."""
    name = (names or {}).get(key, key)
    layer = "silver" if "slv_" in key else "gold" if "gld_" in key else "bronze"
    if catalog is None:
        return f"{layer}.{name}"
    for prefix in ("brz_", "slv_", "gld_"):
        name = name.replace(prefix, "")
    return f"{catalog}.{layer}.{name}"


def ensure_layers(spark: SparkSession, root: str | None = None,
                  layers: tuple[str, ...] = LAYERS, prefix: str = "") -> None:
    """CREATE DATABASE IF NOT EXISTS for each layer (at ``root``/<layer>.db
    when given, so nothing lands in a machine-local warehouse)."""
    for layer in layers:
        loc = f" LOCATION '{root.rstrip('/')}/{prefix}{layer}.db'" if root else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{prefix}{layer}`{loc}")
