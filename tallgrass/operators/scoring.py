"""Weighted scores, categories, priorities and their roll-ups, on (entity_id, feature, norm)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scores import category, priority, weight


def contributions(normed: DataFrame) -> DataFrame:
    c = normed.withColumn("category", category(F.col("feature"))).withColumn("weight", weight(F.col("category")))
    return c.withColumn("contribution", F.col("norm") * F.col("weight"))


def scores(normed: DataFrame) -> DataFrame:
    """overall = sum of contributions / sum of weights, and its priority."""
    s = contributions(normed).groupBy("entity_id").agg((F.sum("contribution") / F.sum("weight")).alias("overall"), F.count("*").alias("n_features"))
    return s.withColumn("priority", priority(F.col("overall")))


def category_scores(normed: DataFrame) -> DataFrame:
    return contributions(normed).groupBy("entity_id", "category").agg((F.sum("contribution") / F.max("weight")).alias("score"))


def top_contributors(normed: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc("contribution"), "feature")
    return contributions(normed).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("entity_id", "feature", "contribution", "rank")


def dominant_category(normed: DataFrame) -> DataFrame:
    """The category with the greatest score; of equal ones the first by name."""
    best = F.min_by("category", F.struct(-F.col("score"), F.col("category")))
    return category_scores(normed).groupBy("entity_id").agg(best.alias("category"), F.max("score").alias("score"))


def priority_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("priority").agg(F.count("*").alias("n"))


def by_group(scored: DataFrame, key: str) -> DataFrame:
    """Candidates (priority above None) by file: count, mean and greatest score."""
    c = scored.filter(F.col("priority") != "None")
    return c.groupBy(key).agg(F.count("*").alias("candidates"), F.avg("overall").alias("mean_score"), F.max(F.abs("overall")).alias("max_score"))
