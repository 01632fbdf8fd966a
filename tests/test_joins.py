"""Broadcast hints only for sides of a fixed size; no job while planning."""

from pyspark.sql import functions as F

from tierlake.operators.joins import lookup_join


def test_lookup_join_plans(spark):
    facts = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    dim = spark.range(7).select(F.col("id").alias("k"), F.lit("name").alias("v"))
    fixed = lookup_join(facts, dim, "k", "left", known_small=True)
    assert "BroadcastHashJoin" in fixed._jdf.queryExecution().executedPlan().toString()
    other = lookup_join(facts, dim, "k", "left")
    assert "strategy=broadcast" not in other._jdf.queryExecution().analyzed().toString()
    assert other.count() == 1000 and fixed.count() == 1000
