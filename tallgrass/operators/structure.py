"""Dispersion of sizes in groups, imbalance and health curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gini(sizes: DataFrame, key: str, value: str) -> DataFrame:
    """2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending x, at least 0.

    Equal sizes are counted first, and ranks follow from the counts, so a group's window holds its distinct sizes only.
    """
    c = sizes.groupBy(key, F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy("x"))
    ranks = F.col("c") * (2 * upto - F.col("c") + 1) / 2  # sum of the ranks of c equal values
    r = c.select(key, "x", "c", (ranks * F.col("x")).alias("ix"))
    n, s = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    g = 2 * F.sum("ix") / F.nullif(n * s, F.lit(0.0)) - (n + 1) / n
    return r.groupBy(key).agg(n.cast("long").alias("n"), F.when((n <= 1) | (s == 0), 0.0).otherwise(F.greatest(F.lit(0.0), g)).alias("gini"))


def entropy(sizes: DataFrame, key: str, value: str) -> DataFrame:
    """-sum p log2 p, from sums alone: log2 S - sum(x log2 x) / S."""
    x = F.col(value).cast("double")
    s = F.sum(x)
    return sizes.filter(x > 0).groupBy(key).agg((F.log2(s) - F.sum(x * F.log2(x)) / s).alias("entropy"))


def imbalance(sizes: DataFrame, key: str, value: str, files: int = 25, dirs: int = 10, loc: int = 2000) -> DataFrame:
    """Pressures of files and size, dispersion, and their weighted sum scaled by the group's size; no subdirectories."""
    t = sizes.groupBy(key).agg(F.count("*").alias("files"), F.sum(F.col(value).cast("double")).alias("total"))
    d = t.join(gini(sizes, key, value).select(key, "gini"), key).join(entropy(sizes, key, value), key, "left")
    spread = F.when(F.col("files") > 1, F.greatest(F.col("gini"), 1 - F.coalesce("entropy", F.lit(0.0)) / F.log2("files"))).otherwise(0.0)
    fp, lp = F.least(F.lit(1.0), F.col("files") / files), F.least(F.lit(1.0), F.col("total") / loc)
    scale = 1 + 0.5 * F.tanh((F.log1p(F.col("files") / 10) / F.ln(F.lit(10.0)) + F.log1p(F.col("total") / 1000) / F.ln(F.lit(1000.0))) / 2)
    return d.select(key, "files", "total", spread.alias("dispersion"), ((0.25 * fp + 0.2 * lp + 0.1 * spread) * scale).alias("imbalance"))


def weighted_health(scored: DataFrame, key: str, size: str, health: str) -> DataFrame:
    """Size-weighted mean and least health by group."""
    w = F.col(size).cast("double")
    return scored.groupBy(key).agg((F.sum(w * F.col(health)) / F.sum(w)).alias("mean_health"), F.min(health).alias("min_health"))
