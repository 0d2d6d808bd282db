"""Fit and apply feature statistics on the long form (entity_id, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scores import clamp, finite
from tallgrass.session import written

EPS = 1e-12
CONFIDENCE = {"High": 0.9, "Medium": 0.7, "Low": 0.5, "VeryLow": 0.3, "Insufficient": 0.1}
#: Beta(a, b) by group of features.
PRIOR_GROUPS = {"complexity": (2.0, 5.0), "centrality": (1.0, 10.0), "cycles": (1.0, 4.0), "clones": (1.0, 8.0)}


def moments(features: DataFrame) -> DataFrame:
    """n, mean, variance, std, min and max of each feature: sums alone, combined before the shuffle."""
    v = F.col("value")
    return features.groupBy("feature").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def counts(features: DataFrame) -> DataFrame:
    """(feature, value, c, part): the distinct values of each feature counted and dealt out by range, as a table."""
    c = features.groupBy("feature", "value").agg(F.count("*").alias("c"))
    return _dealt(c)


def _dealt(c: DataFrame) -> DataFrame:
    return written(c.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()), "counts")


def quantiles(features: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation at share * (n - 1): feature and a column for each name."""
    return counted_quantiles(counts(features), shares)


def counted_quantiles(c: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The same from counts().

    Each part's running counts, moved by the counts of the parts before it (a row for each part and feature), are ranks, so
    that no task holds a feature's values.
    """
    parts = c.groupBy("feature", "part").agg(F.sum("c").alias("in_part"))
    before = parts.select("feature", "part", (F.sum("in_part").over(Window.partitionBy("feature").orderBy("part")) - F.col("in_part")).alias("before"), F.sum("in_part").over(Window.partitionBy("feature")).alias("n"))
    upto = F.sum("c").over(Window.partitionBy("feature", "part").orderBy("value"))
    ranked = c.select("feature", "part", "value", "c", upto.alias("upto")).join(before, ["feature", "part"])
    last, n = F.col("before") + F.col("upto"), F.col("n")
    picked = []
    for name, share in shares.items():
        at = F.floor(share * (n - 1) + 1e-9)
        for end, rank in (("low", at), ("high", F.least(at + 1, n - 1))):
            hit = (rank >= last - F.col("c")) & (rank < last)
            picked.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}_{end}"))
    rows = ranked.groupBy("feature").agg(F.max("n").alias("n"), *picked)
    part = lambda share: share * (F.col("n") - 1) - F.floor(share * (F.col("n") - 1) + 1e-9)
    return rows.select("feature", *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.greatest(F.lit(0.0), part(v))).alias(k) for k, v in shares.items()])


def fit(features: DataFrame) -> DataFrame:
    """n, mean, variance, std, min, max, median, q1, q3, iqr and mad of each feature, all from one table of counts."""
    c = counts(features)
    v, w = F.col("value"), F.col("c")
    q = counted_quantiles(c, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = c.groupBy("feature").agg(F.sum("c").alias("n"), (F.sum(v * w) / F.sum("c")).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    one = written(q.join(m, "feature"), "quartiles")  # one row for each feature
    held = c.join(one.select("feature", "mean", "median"), "feature")
    spread = held.groupBy("feature").agg(F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"))
    away = held.groupBy("feature", F.abs(v - F.col("median")).alias("value")).agg(F.sum("c").alias("c"))
    variance = F.when(F.col("n") > 1, F.col("squares") / (F.col("n") - 1)).otherwise(0.0)
    s = one.join(spread, "feature").withColumn("variance", variance).withColumn("std", F.sqrt("variance"))
    s = s.join(counted_quantiles(_dealt(away), {"mad": 0.5}), "feature")
    return s.select("feature", "n", "mean", "variance", "std", "min", "max", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "mad")


def scaled(x: Column, low: Column, high: Column, empty: float = 0.5) -> Column:
    return F.when(high - low < EPS, empty).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def normalize(features: DataFrame, stats: DataFrame, scheme: str) -> DataFrame:
    """Adds norm: zscore, minmax or robust; clamped to [-10, 10], not-a-number and infinity to 0."""
    v, f = F.col("value"), features.join(F.broadcast(stats), "feature")  # a row for each feature
    if scheme == "zscore":
        x = F.when(F.col("variance") < EPS, 0.0).otherwise((v - F.col("mean")) / F.nullif("std", F.lit(0.0)))
    elif scheme == "minmax":
        x = scaled(v, F.col("min"), F.col("max"))
    elif scheme == "robust":
        centred = v - F.col("median")
        x = F.when(F.col("mad") > EPS, centred / (1.4826 * F.nullif("mad", F.lit(0.0)))).when(F.col("iqr") > EPS, centred / F.nullif("iqr", F.lit(0.0))).otherwise(0.0)
    else:
        raise ValueError(scheme)
    return f.select(*features.columns, clamp(finite(x), -10.0, 10.0).alias("norm"))


def confidence(stats: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Adds confidence and its weight, from the sample's size and variance."""
    n, var = F.col("n"), F.col("variance")
    name = (
        F.when((n < 2) | (var < EPS), "Insufficient")
        .when((n >= 50) & (var > threshold), "High")
        .when((n >= 10) & (var > 0.5 * threshold), "Medium")
        .when((n >= 5) & (var > 0.1 * threshold), "Low")
        .otherwise("VeryLow")
    )
    w = F.lit(None).cast("double")
    for k, x in CONFIDENCE.items():
        w = F.when(F.col("confidence") == k, x).otherwise(w)
    return stats.withColumn("confidence", name).withColumn("confidence_weight", w)


def posterior(stats: DataFrame, priors: DataFrame) -> DataFrame:
    """Normal-normal posterior of each feature's mean; priors: feature, alpha, beta (1, 1 where there is none)."""
    a, b = F.coalesce("alpha", F.lit(1.0)), F.coalesce("beta", F.lit(1.0))
    s = stats.join(priors, "feature", "left").withColumn("prior_mean", a / (a + b)).withColumn("prior_variance", a * b / ((a + b) * (a + b) * (a + b + 1)))
    ev = F.greatest("variance", F.lit(EPS))
    s = s.withColumn("posterior_variance", 1 / (1 / F.col("prior_variance") + F.col("n") / ev))
    mean = F.col("posterior_variance") * (F.col("prior_mean") / F.col("prior_variance") + F.col("n") * F.col("mean") / ev)
    base = F.col("confidence_weight")
    inverse = F.when(base == 0.9, 0.1).when(base == 0.7, 0.3).when(base == 0.5, 0.5).when(base == 0.3, 0.7).otherwise(0.9)
    return s.withColumn("posterior_mean", mean).withColumn("prior_weight", clamp(inverse / (1 + F.ln("n")), 0.05, 0.95))


def clamped(features: DataFrame, definitions: DataFrame) -> DataFrame:
    """Values within their definition's range; not-a-number and infinity become the default."""
    v = F.col("value")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    x = F.when(bad, F.col("default")).otherwise(F.greatest("low", F.least("high", v)))
    return features.join(definitions, "feature").select(*features.columns, x.alias("clamped"))


def norms(features: DataFrame) -> DataFrame:
    return features.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
