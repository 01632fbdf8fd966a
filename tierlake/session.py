"""Session helpers: shared scratch folder and the local test session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system, so it is read from the
    session. Only a local session without one (tests) gets a fresh folder of
    this machine; on a cluster that would be a folder no executor sees, so
    there a missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # The conf itself cannot change at run time: set the context's dir.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tierlake-ckpt-"))
        root = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared scratch root."""
    return f"{scratch_root(spark)}/tierlake/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint to the shared checkpoint dir: one job that
    computes and writes the frame; the result reads the written files, so
    it survives executor loss and the plan restarts from there (never a
    local checkpoint). Output partitioning is kept."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench: AQE on, UTC, no UI."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tierlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
