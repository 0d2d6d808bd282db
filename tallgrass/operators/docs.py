"""Documentation audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incomplete(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | text.rlike("(?i)TODO|FIXME|TBD")


def missing(complex_: DataFrame, present: DataFrame, key: str, least: int) -> DataFrame:
    """Groups of more than least that have no entry in present."""
    return complex_.filter(F.col("n") > least).join(present.distinct(), key, "left_anti")


def changes_since(changes: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Changes of each group after its last mark (all where there is none)."""
    last = marks.groupBy(key).agg(F.max("ts").alias("mark"))
    return changes.join(last, key, "left").groupBy(key).agg(F.count_if(F.col("mark").isNull() | (F.col("ts") > F.col("mark"))).alias("since"))


def log_scores(gaps: DataFrame) -> DataFrame:
    """100 (1 - log10(gaps + 1) / log10(most + 1)); 100 without gaps."""
    most = gaps.agg(F.max("gaps").alias("most"))  # one row
    score = 100 * (1 - F.log10(F.col("gaps") + 1) / F.log10(F.col("most") + 1))
    return gaps.crossJoin(F.broadcast(most)).withColumn("score", F.when(F.col("gaps") == 0, 100.0).otherwise(score)).drop("gaps", "most")
