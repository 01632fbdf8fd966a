"""What a join does to the rows of its sides, without running the join.

Keys of both sides are counted (partial counts before the shuffle, so a key
that holds a third of all rows is one number per task) and meet in one
aggregation of key counts. A key with l rows on the left and r on the right
makes l * r rows of the inner join; that gives the rows that a join loses,
keeps and multiplies. NULL keys match nothing.

Products are decimals of 38 digits. The result is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.functions.clean import any_null


def _key_counts(df: DataFrame, keys: list[str], names: list[str], side: str, other: str) -> DataFrame:
    renamed = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    return renamed.groupBy(*names).agg(F.count(F.lit(1)).alias(side)).withColumn(other, F.lit(0).cast("long"))


def join_profile(left: DataFrame, right: DataFrame, left_keys: list[str],
                 right_keys: list[str] | None = None) -> DataFrame:
    """One row:

    left_rows, right_rows            rows of the sides
    left_null_keys, right_null_keys  rows with a NULL in the key
    left_unmatched, right_unmatched  rows whose (whole) key the other side lacks
    left_multiplied                  left rows whose key occurs more than once
                                     on the right
    max_matches                      most right rows of a left row's key
    inner_rows, left_join_rows       rows that the joins would return
    extra_rows                       rows that the left join adds to the left
                                     side
    """
    right_keys = right_keys or left_keys
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("both sides need the same number of keys, one at least")
    names = [f"k{i}" for i in range(len(left_keys))]
    both = _key_counts(left, left_keys, names, "l", "r").unionByName(
        _key_counts(right, right_keys, names, "r", "l")).groupBy(*names).agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"))
    null = any_null(names)
    matched = ~null & (F.col("l") > 0) & (F.col("r") > 0)

    def total(value, where):
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0))

    product = F.col("l").cast("decimal(38,0)") * F.col("r").cast("decimal(38,0)")
    one = both.agg(
        total(F.col("l"), F.lit(True)).alias("left_rows"), total(F.col("r"), F.lit(True)).alias("right_rows"),
        total(F.col("l"), null).alias("left_null_keys"), total(F.col("r"), null).alias("right_null_keys"),
        total(F.col("l"), ~null & (F.col("r") == 0)).alias("left_unmatched"),
        total(F.col("r"), ~null & (F.col("l") == 0)).alias("right_unmatched"),
        total(F.col("l"), matched & (F.col("r") > 1)).alias("left_multiplied"),
        F.coalesce(F.max(F.when(matched, F.col("r"))), F.lit(0)).alias("max_matches"),
        total(product, matched).cast("decimal(38,0)").alias("inner_rows"))
    alone = F.col("left_null_keys") + F.col("left_unmatched")
    return one.select("*", (F.col("inner_rows") + alone).cast("decimal(38,0)").alias("left_join_rows")).select(
        "*", (F.col("left_join_rows") - F.col("left_rows")).cast("decimal(38,0)").alias("extra_rows"))
