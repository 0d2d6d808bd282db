"""Merging partial results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted(parts: DataFrame, key: str) -> DataFrame:
    """Counts add, means are weighted by them (plain mean if all are 0), maxima stay maxima."""
    n = F.sum("n")
    return parts.groupBy(key).agg(n.alias("n"), F.when(n == 0, F.avg("mean")).otherwise(F.sum(F.col("mean") * F.col("n")) / F.nullif(n, F.lit(0))).alias("mean"), F.max("most").alias("most"))


def summed(entries: DataFrame) -> DataFrame:
    return entries.groupBy("k").agg(F.sum("n").alias("n"))
