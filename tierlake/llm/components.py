"""Connected components by repeated contraction.

Each round gives every node the least node within two steps, by an order that
is hashed anew each round; edges are rewritten to those nodes and the ones
that became loops go. A star collapses in one round and a path shrinks by a
factor, so the rounds grow with the logarithm of the size. All steps are
aggregations and joins (a hub's edges are combined before the shuffle); every
round is cut with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(pairs: DataFrame, key: str, value: str, salt: int) -> DataFrame:
    """The value that comes first in the round's order, for each key."""
    order = F.struct(F.xxhash64(F.lit(salt), F.col(value)).alias("h"), F.col(value).alias("v"))
    return pairs.groupBy(key).agg(F.min(order).alias("m")).select(
        F.col(key).alias("node"), F.col("m.v").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b): nodes are
    connected if and only if they have the same root. NULL ends and loops link
    nothing; repeated edges count once. Runs jobs."""
    left = cut_lineage(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots, salt = None, 0
    while not left.isEmpty():
        salt += 1
        pairs = _both(left)
        near = pairs.unionByName(pairs.select("a", F.col("a").alias("b")))
        one = _least(near, "a", "b", salt)
        reach = near.join(one.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b"))
        two = cut_lineage(_least(reach, "a", "b", salt))
        moved = left.join(two.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(
            two.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = cut_lineage(moved.where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if roots is None:
            roots = two.withColumnRenamed("to", "root")
        else:
            step = two.select(F.col("node").alias("root"), "to")
            roots = cut_lineage(roots.join(step, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")))
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
