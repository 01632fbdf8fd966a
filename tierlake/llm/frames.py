"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Words of the contracts: runs without space, tab, line feed, vertical tab,
#: form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text (a NULL id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


#: Bytes of a batch that Spark sends to Python, and of the part of it that is
#: worked on at a time, about.
BATCH_BYTES = PART_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of this session to ``BATCH_BYTES``: texts are
    long, and several batches are held at once on both sides. A session that
    has a lower limit keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch, of about ``PART_BYTES`` on average."""
    rows = max(1, batch.num_rows // (1 + batch.nbytes // PART_BYTES))
    for lo in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(lo, rows)


def add_columns(df: DataFrame, new: list[StructField],
                make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
                drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with columns that ``make()`` computes from each Arrow batch, and
    without the columns of ``drop``.

    ``make`` runs once in each task and returns the function for its batches.
    A batch is worked on in slices of about ``PART_BYTES``, so a task holds the
    results of one slice. Existing columns named like a new one are replaced.
    """
    names = {*drop, *(f.name for f in new)}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = StructType([*kept, *new])
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in (part for whole in batches for part in slices(whole)):
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*old, *compute(batch)], names=schema.names)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def free_prefix(df: DataFrame) -> str:
    """What no column of ``df`` starts with, for names of helper columns."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, the first by a hash of the key columns
    (all columns if none are given).

    A first filter on the hash leaves about twice as many as asked for, so the
    sort at the end sees a bounded number of rows whatever the size and the
    number of tasks. Counts ``df`` (a job)."""
    h = F.xxhash64(F.lit("sample"), *(key or df.columns))
    total = df.count()
    share = min(1.0, (2 * rows + 50) / max(total, 1))
    near = df.withColumn("_h", h).where(F.pmod(F.xxhash64("_h"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return near.orderBy("_h").limit(rows).drop("_h")
