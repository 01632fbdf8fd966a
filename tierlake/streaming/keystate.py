"""Keys seen by earlier loads: duplicates across micro-batches.

A check of one micro-batch can't see that a key came with an earlier one.
``KeyState`` keeps how often each key occurred so far, in ``buckets`` by the
hash of the key. A micro-batch's keys are counted first (a key that holds most
rows is one number before the shuffle); only buckets with new keys are merged
and written, as a new version ``bucket=<b>/upto=<batch>``. A bucket of many
keys is merged in slices of about ``SLICE_ROWS``, a file each, so that tasks
stay as small as they are while the state grows.

A version is computed from the last one of an *earlier* batch, and writing it
again replaces it, so a batch that is replayed after a failure changes
nothing. The version before the newest is kept for such a replay, older ones
are deleted. Which versions exist is a listing of folders, at most two a bucket.

Rows with a NULL in the key have no key and aren't counted here (the NULL-key
check has them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tierlake.functions.clean import any_null

BUCKET, UPTO, SLICE = "bucket", "upto", "slice"
SLICE_ROWS = 250_000


@dataclass(frozen=True)
class KeyState:
    """State of the keys of one table under a shared folder. ``schema`` has
    the key columns; ``buckets`` is fixed for the life of the state."""

    root: str
    schema: StructType
    buckets: int = 64

    @property
    def keys(self) -> list[str]:
        return self.schema.fieldNames()

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("n", LongType()), StructField("n_new", LongType()),
                           StructField(BUCKET, LongType()), StructField(UPTO, LongType())])

    def versions(self, spark: SparkSession) -> dict[int, list[int]]:
        """Stored batches of each bucket, ascending."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[int, list[int]] = {}
        if fs.exists(root):
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{BUCKET}=*/{UPTO}=*")):
                path = status.getPath()
                bucket = int(path.getParent().getName().split("=")[1])
                found.setdefault(bucket, []).append(int(path.getName().split("=")[1]))
        return {b: sorted(v) for b, v in found.items()}

    def _read(self, spark: SparkSession, chosen: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/{BUCKET}={b}/{UPTO}={v}" for b, v in chosen.items()]
        if not paths:
            return spark.createDataFrame([], self._stored())
        return spark.read.schema(self._stored()).option("basePath", self.root).parquet(*paths)

    def current(self, spark: SparkSession, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Keys and their counts ``n`` (``n_new`` of them from the bucket's
        last batch), up to the batch before ``before`` if given."""
        chosen = {}
        for b, stored in self.versions(spark).items():
            old = [v for v in stored if before is None or v < before]
            if old and (buckets is None or b in buckets):
                chosen[b] = old[-1]
        return self._read(spark, chosen)

    def merge(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Add the keys of a micro-batch and return those of its keys that
        occurred before or more than once in it: keys, ``n`` so far, ``n_new``
        in this batch. Runs jobs; ``df`` is read twice, for its key columns."""
        spark = df.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))
        keyed = df.where(~any_null(self.keys)).select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        added = keyed.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).withColumns(
            {"n_new": F.col("n"), BUCKET: bucket})
        rows = {r[0]: r[1] for r in keyed.groupBy(bucket).count().collect()}  # at most ``buckets``
        touched = list(rows)
        if not touched:
            return self._read(spark, {})
        old = self.current(spark, before=batch_id, buckets=touched).select(
            *self.keys, "n", F.lit(0).cast("long").alias("n_new"), BUCKET)
        for r in old.groupBy(BUCKET).count().collect():
            rows[r[0]] += r[1]
        slices = -(-max(rows.values()) // SLICE_ROWS)
        tasks = -(-sum(rows.values()) // SLICE_ROWS)
        merged = old.unionByName(added).withColumn(SLICE, F.pmod(F.hash(*self.keys), F.lit(slices))).repartition(
            tasks, BUCKET, SLICE).groupBy(BUCKET, SLICE, *self.keys).agg(
            F.sum("n").alias("n"), F.sum("n_new").alias("n_new"))
        stored = merged.withColumn(UPTO, F.lit(batch_id).cast("long")).select(*self._stored().fieldNames())
        (stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET, UPTO).parquet(self.root))
        self._forget(spark, touched)
        return self._read(spark, {b: batch_id for b in touched}).where("n_new > 0 AND n > 1").select(
            *self.keys, "n", "n_new")

    def duplicates(self, spark: SparkSession) -> DataFrame:
        """Every key that occurred more than once in all loads, with ``n``."""
        return self.current(spark).where("n > 1").select(*self.keys, "n")

    def _forget(self, spark: SparkSession, buckets: list[int]) -> None:
        """Delete versions older than the one before the newest."""
        jvm = spark.sparkContext._jvm
        stored = self.versions(spark)
        for b in buckets:
            for v in stored.get(b, [])[:-2]:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{BUCKET}={b}/{UPTO}={v}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
