"""Lookup joins.

A side is broadcast by hint only when its size is fixed in the code (inline
lookup tables). Any other join is left to Spark's planner and to AQE, which
chooses by the sizes it measures at run time and splits skewed partitions;
nothing runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column,
                how: str = "left", known_small: bool = False) -> DataFrame:
    """Join ``left`` to a lookup ``right``. ``known_small`` says that
    ``right`` has a fixed size, and broadcasts it."""
    return left.join(F.broadcast(right) if known_small else right, on, how)
