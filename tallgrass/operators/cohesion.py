"""Embedding cohesion by group on (id, grp, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v scaled to length 1; a vector near zero stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n < 1e-10, x.cast("double")).otherwise(x.cast("double") / F.nullif(n, F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 for unequal sizes and vectors near zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 1e-10), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(n, F.lit(0.0))))).otherwise(0.0)


def sums(vectors: DataFrame) -> DataFrame:
    """(grp, n, s): count and sum of the unit vectors, a mergeable state. All vectors have the first one's length."""
    units = vectors.select("grp", unit(F.col("v")).alias("u"))
    first = units.select(F.size("u").alias("n")).first()
    d = first.n if first else 0
    parts = units.groupBy("grp").agg(F.count("*").alias("n"), *[F.sum(F.get("u", i)).alias(f"s{i}") for i in range(d)])
    return parts.select("grp", "n", (F.array(*[f"s{i}" for i in range(d)]) if d else F.array().cast("array<double>")).alias("s"))


def weighted_sums(states: DataFrame, weight: Column) -> DataFrame:
    """States (key, grp, n, s) of several groups under one key, added with a weight of each."""
    w = states.withColumn("w", weight)
    first = w.select(F.size("s").alias("n")).first()
    d = first.n if first else 0
    total = w.groupBy("key").agg(F.sum("w").alias("weight"), F.sum("n").alias("n"), *[F.sum(F.col("w") * F.get("s", i)).alias(f"s{i}") for i in range(d)])
    s = F.array(*[f"s{i}" for i in range(d)]) if d else F.array().cast("array<double>")
    return total.select("key", "n", "weight", s.alias("s"))


def merged_cohesion(states: DataFrame) -> DataFrame:
    """Length of the weighted sum over the weight; 1 for a weight below two."""
    return states.select("key", "n", "weight", F.when(F.col("weight") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(dot(F.col("s"), F.col("s"))) / F.col("weight"))).alias("cohesion"))


def alignment(a: Column, b: Column) -> Column:
    """Cosine, from 0 on."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def issues(files: DataFrame, outliers_: DataFrame) -> DataFrame:
    """(grp, code): COH004 for each outlier below .2, COH006 for a cohesion below .3 of five and more, COH001 for a documentation alignment below .4."""
    low = outliers_.filter("similarity < 0.2").select("grp", F.col("id").cast("string").alias("what"), F.lit("COH004").alias("code"))
    loose = files.filter("cohesion < 0.3 and n >= 5").select("grp", F.lit("").alias("what"), F.lit("COH006").alias("code"))
    apart = files.filter("doc < 0.4").select("grp", F.lit("").alias("what"), F.lit("COH001").alias("code"))
    return low.unionAll(loose).unionAll(apart)


def overview(files: DataFrame) -> DataFrame:
    """One row: mean cohesion, and the mean of the alignments there are; 1 where there is nothing."""
    return files.agg(F.coalesce(F.avg("cohesion"), F.lit(1.0)).alias("cohesion"), F.coalesce(F.avg("doc"), F.lit(1.0)).alias("doc"))


def centroids(vectors: DataFrame) -> DataFrame:
    return sums(vectors).select("grp", "n", unit(F.col("s")).alias("centroid"))


def cohesion(vectors: DataFrame) -> DataFrame:
    """Length of the sum of unit vectors over their number; 1 for fewer than two."""
    s = sums(vectors)
    return s.select("grp", "n", F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(dot(F.col("s"), F.col("s"))) / F.col("n"))).alias("cohesion"))


def similarities(vectors: DataFrame) -> DataFrame:
    c = centroids(vectors)
    return vectors.join(c, "grp").select("id", "grp", "n", "v", cosine(F.col("v"), F.col("centroid")).alias("similarity"))


def trimmed(vectors: DataFrame, share: float = 0.15) -> DataFrame:
    """Without each group's ceil(share) least similar members (one stays)."""
    w = Window.partitionBy("grp").orderBy(F.round("similarity", 9), "id")
    gone = F.least(F.ceil(F.col("n") * share), F.col("n") - 1)
    return similarities(vectors).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") > gone).select("id", "grp", "v")


def outliers(vectors: DataFrame, share: float = 0.1, least: float = 0.0) -> DataFrame:
    """Members of groups of three and more whose similarity is below that at position floor(n * share) or below least."""
    s = similarities(vectors).withColumn("similarity", F.round("similarity", 9))
    w = Window.partitionBy("grp").orderBy("similarity", "id")
    r = s.filter("n >= 3").withColumn("rank", F.row_number().over(w) - 1)
    edge = r.filter(F.col("rank") == F.floor(F.col("n") * share)).select("grp", F.greatest(F.col("similarity"), F.lit(least)).alias("edge"))
    return r.join(edge, "grp").filter("similarity < edge").select("id", "grp", "similarity")
