"""Joins of line ranges within a file.

Ranges are cut into buckets of ``width`` lines, and the equi-join runs on (file, bucket), so a file with very many ranges
spreads over many tasks and compares only ranges near one another. Each pair is found in one bucket only: no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(line: Column, width: int) -> Column:
    return F.floor(line / width).cast("long")


def contained(outer: DataFrame, points: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of outer (file, s, e, ...) and points (file, p_s, p_e, ...) that start and end within it."""
    o = outer.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("s"), width), _bucket(F.greatest("s", "e"), width))))
    p = points.withColumn("bucket", _bucket(F.col("p_s"), width))
    return o.join(p, ["file", "bucket"]).filter((F.col("p_s") >= F.col("s")) & (F.col("p_e") <= F.col("e"))).drop("bucket")


def overlapping(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of a (file, s, e, ...) and b (file, s2, e2, ...) that share a line, ends included."""
    x = a.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("s"), width), _bucket(F.greatest("s", "e"), width))))
    y = b.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("s2"), width), _bucket(F.greatest("s2", "e2"), width))))
    met = x.join(y, ["file", "bucket"]).filter((F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")))
    # the bucket where the later of the two starts is the pair's own
    return met.filter(F.col("bucket") == _bucket(F.greatest("s", "s2"), width)).drop("bucket")
