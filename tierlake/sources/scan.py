"""Parquet scans, spread over more tasks where the caller asks for it.

An input stored as few unsplittable pieces (one big row group) is scanned by
few tasks. A caller who knows such an input passes ``partitions``; the
round-robin shuffle is then in the plan at every input size. Filters and
column pruning still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df
