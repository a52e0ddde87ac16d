"""Differences between two sets of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with side = left or right."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
