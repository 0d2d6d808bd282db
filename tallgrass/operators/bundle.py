"""Token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix(items: DataFrame, key: str, id_: str, budget: int) -> DataFrame:
    """Items by falling priority up to the first that overflows the group's budget."""
    w = Window.partitionBy(key).orderBy(F.desc("priority"), id_)
    return items.withColumn("upto", F.sum("tokens").over(w)).filter(F.col("upto") <= budget)


def greedy(items: DataFrame, key: str, id_: str, budget: int) -> DataFrame:
    """Items by falling priority, passing over those that no longer fit: a fold over each group's candidates.

    An item larger than the whole budget can never be taken, so it is left out before the groups are gathered.
    """
    item = F.struct((-F.col("priority")).alias("p"), F.col(id_).alias("id"), F.col("tokens"))
    g = items.filter(F.col("tokens") <= budget).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(s, x):
        fits = s["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["ids"], x["id"])).otherwise(s["ids"]).alias("ids"))

    return g.select(key, F.aggregate("items", start, step).alias("r")).select(key, F.col("r.used").alias("used"), F.array_join("r.ids", ",").alias("ids"))


def ending_in(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """Parts whose key is known and whose size is over 25, or whose name ends in a known key."""
    exact = parts.filter("p_size > 25").join(keys, "k", "left_semi").select("p_partkey")
    digits = parts.select("p_partkey", F.regexp_extract("p_name", "([0-9]+)$", 1).alias("d"))
    ends = digits.filter("d <> ''").select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("d")), lambda n: F.right("d", n))).alias("s"))
    named = ends.join(keys.select(F.col("k").cast("string").alias("s")), "s", "left_semi").select("p_partkey")
    return exact.unionByName(named).distinct()
