"""Complexity scores and issues from decision points, token counts and entities' line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.scores import clamp
from tallgrass.operators import ranges

#: Low, medium, high and very high by metric.
THRESHOLDS = {
    "cyclomatic": (5.0, 10.0, 15.0, 25.0),
    "cognitive": (5.0, 15.0, 25.0, 50.0),
    "nesting": (2.0, 4.0, 6.0, 10.0),
    "parameters": (3.0, 5.0, 8.0, 12.0),
    "file_length": (100.0, 300.0, 500.0, 1000.0),
    "function_length": (15.0, 30.0, 50.0, 100.0),
}
#: Severities, the least first.
SEVERITIES = ("Low", "Moderate", "High", "Critical")


def thresholds(spark) -> DataFrame:
    """(metric, low, medium, high, very_high): one row for each metric."""
    return spark.createDataFrame([(k, *v) for k, v in THRESHOLDS.items()], "metric string, low double, medium double, high double, very_high double")


def of_files(points: DataFrame) -> DataFrame:
    """Decision points (file, nesting): cyclomatic 1 + n, cognitive sum(1 + nesting), greatest nesting."""
    return points.groupBy("file").agg((1 + F.count("*")).alias("cyclomatic"), F.sum(1 + F.col("nesting")).alias("cognitive"), F.max("nesting").alias("nesting"))


def of_entities(entities: DataFrame, points: DataFrame, width: int = 64) -> DataFrame:
    """Entities (id, file, s, e) with the same three of the points (file, s, e, nesting) inside them; 1, 0, 0 where there are none."""
    p = points.select("file", F.col("s").alias("p_s"), F.col("e").alias("p_e"), "nesting")
    inside = ranges.contained(entities.select("id", "file", "s", "e"), p, width).groupBy("id").agg(F.count("*").alias("n"), F.sum(1 + F.col("nesting")).alias("c"), F.max("nesting").alias("d"))
    zero = F.lit(0).cast("long")
    return entities.join(inside, "id", "left").select(*entities.columns, (1 + F.coalesce("n", zero)).alias("cyclomatic"), F.coalesce("c", zero).alias("cognitive"), F.coalesce("d", zero).alias("nesting"))


def halstead_counts(tokens: DataFrame, operator: Column) -> DataFrame:
    """(id, token) -> distinct operators n1 and operands n2, and all of them, all1 and all2."""
    kind = tokens.select("id", "token", operator.alias("op")).groupBy("id", "token", "op").agg(F.count("*").alias("c"))
    return kind.groupBy("id").agg(F.count_if("op").alias("n1"), F.count_if(~F.col("op")).alias("n2"), F.coalesce(F.sum(F.when(F.col("op"), F.col("c"))), F.lit(0)).alias("all1"), F.coalesce(F.sum(F.when(~F.col("op"), F.col("c"))), F.lit(0)).alias("all2"))


def halstead(n1: Column, n2: Column, all1: Column, all2: Column) -> dict[str, Column]:
    """Vocabulary, length, volume, difficulty, effort, time, bugs and estimated length."""
    vocabulary, length = n1 + n2, all1 + all2
    volume = F.when((vocabulary > 0) & (length > 0), length * F.log2(vocabulary.cast("double"))).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2 * (all2 / F.greatest(n2, F.lit(1)))).otherwise(0.0)
    part = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": difficulty * volume, "time": difficulty * volume / 18, "bugs": volume / 3000, "estimated": part(n1) + part(n2)}


def debt(cyclomatic: Column, cognitive: Column, loc: Column) -> Column:
    capped = lambda x, most: F.least(x / most, F.lit(1.0))
    return 100 * (0.4 * capped(cyclomatic, 20) + 0.4 * capped(cognitive, 50) + 0.2 * capped(loc, 100))


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    v = F.when(volume <= 0, 1.0).otherwise(volume)
    return clamp(171 - 5.2 * F.ln(v) - 0.23 * cyclomatic - 16.2 * F.ln(loc.cast("double")), 0.0, 100.0)


def severity(cyclomatic: Column, cognitive: Column) -> Column:
    """The greater of two ladders: medium, high and very high thresholds of either give Moderate, High and Critical."""
    rank = lambda x, k: F.when(x >= THRESHOLDS[k][3], 3).when(x >= THRESHOLDS[k][2], 2).when(x >= THRESHOLDS[k][1], 1).otherwise(0)
    most = F.greatest(rank(cyclomatic, "cyclomatic"), rank(cognitive, "cognitive"))
    return F.get(F.array(*map(F.lit, SEVERITIES)), most)


def grade(value: Column, low: Column, medium: Column, high: Column, very_high: Column) -> Column:
    """The ladder that counts a threshold itself to the step below."""
    return F.when(value <= low, "Low").when(value <= medium, "Medium").when(value <= high, "High").when(value <= very_high, "VeryHigh").otherwise("Critical")


def issues(entities: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, metric, value, severity) for each of cyclomatic, cognitive and nesting above its high threshold."""
    long = entities.select("id", *[F.col(c).cast("double").alias(c) for c in ("cyclomatic", "cognitive", "nesting")]).unpivot("id", ["cyclomatic", "cognitive", "nesting"], "metric", "value")
    hit = long.join(F.broadcast(limits), "metric").filter(F.col("value") > F.col("high"))  # a row for each metric
    return hit.select("id", "metric", "value", F.when(F.col("value") >= F.col("very_high"), "Critical").otherwise("High").alias("severity"))


def large_files(files: DataFrame, most: int = 500) -> DataFrame:
    """(file, lines) of files with more lines."""
    return files.filter(F.col("lines") > most).select("file", "lines", F.lit("large_file").alias("kind"))


def averages(entities: DataFrame) -> DataFrame:
    """One row: means of cyclomatic, cognitive, debt (0 if there is nothing) and maintainability (100)."""
    mean = lambda c, empty: F.coalesce(F.avg(c), F.lit(empty)).alias(f"mean_{c}")
    return entities.agg(mean("cyclomatic", 0.0), mean("cognitive", 0.0), mean("debt", 0.0), mean("maintainability", 100.0), F.count("*").alias("entities"))


def matched(entities: DataFrame, results: DataFrame, width: int = 64) -> DataFrame:
    """Entities (id, name, file, s, e) with the greatest metrics of the results that have the id, or name and file, or share a line.

    Where none does, the file's worst result by cyclomatic. The three ways are joins of their own: no disjunction is joined.
    """
    r = results.select(F.col("id").alias("r_id"), F.col("name").alias("r_name"), "file", F.col("s").alias("s2"), F.col("e").alias("e2"), "cyclomatic", "cognitive")
    own = ["id", "r_id", "cyclomatic", "cognitive"]
    by_id = entities.join(r.drop("file"), F.col("id") == F.col("r_id")).select(own)
    by_name = entities.join(r.withColumnRenamed("r_name", "name"), ["name", "file"]).select(own)
    by_range = ranges.overlapping(entities, r, width).select(own)
    best = by_id.unionAll(by_name).unionAll(by_range).groupBy("id").agg(F.max("cyclomatic").alias("cyc"), F.max("cognitive").alias("cog"))
    worst = r.groupBy("file").agg(F.max(F.struct("cyclomatic", "cognitive")).alias("w"))
    out = entities.join(best, "id", "left").join(worst, "file", "left")
    return out.select("id", F.coalesce("cyc", "w.cyclomatic").alias("cyclomatic"), F.coalesce("cog", "w.cognitive").alias("cognitive"), F.col("cyc").isNull().alias("fallback"))


def blocks(kinds: DataFrame, block: list[str], function: list[str]) -> DataFrame:
    """(file, kind): max(1, blocks + 2 functions)."""
    n = F.count_if(F.col("kind").isin(block)) + 2 * F.count_if(F.col("kind").isin(function))
    return kinds.groupBy("file").agg(F.greatest(F.lit(1), n).alias("blocks"))


def scored(entities: DataFrame) -> DataFrame:
    """Fixed 0-100 scoring of (id, loc, cyclomatic, cognitive, nesting, debt, maintainability, severity, issues)."""
    c = lambda x: clamp(x, 0.0, 100.0)
    cyc, cog, nest, owed, bad = c(F.col("cyclomatic") / 10.0 * 40), c(F.col("cognitive") / 15.0 * 30), c(F.col("nesting") * 6.0), c(F.col("debt")), c(100 - F.col("maintainability"))
    # fixed values: the weights and curves
    overall = c(0.30 * cyc + 0.25 * cog + 0.15 * nest + 0.20 * owed + 0.10 * bad)
    s = entities.select("id", "loc", "severity", "issues", overall.alias("overall"))
    by_score = F.when(F.col("overall") >= 70, "Critical").when(F.col("overall") >= 55, "High").when(F.col("overall") >= 35, "Medium").when(F.col("overall") >= 20, "Low").otherwise("None")
    by_severity = F.when(F.col("severity") == "Critical", "Critical").when(F.col("severity") == "High", "High").when(F.col("severity") == "Moderate", "Medium").otherwise("Low")
    sure = F.when(F.col("loc") >= 30, 0.95).when(F.col("loc") >= 15, 0.85).when(F.col("loc") >= 5, 0.7).otherwise(0.5)
    return s.select("id", "overall", F.when(F.col("issues") == 0, by_score).otherwise(by_severity).alias("priority"), sure.alias("confidence"))


def features(entities: DataFrame) -> DataFrame:
    """(id, feature, value): six metrics over fixed divisors; all but debt and maintainability stop at 1."""
    share = {"cyclomatic": (10.0, True), "cognitive": (15.0, True), "nesting": (5.0, True), "loc": (100.0, True), "debt": (100.0, False), "maintainability": (100.0, False)}
    wide = entities.select("id", *[(F.least(F.col(k) / d, F.lit(1.0)) if cap else F.col(k) / d).alias(k) for k, (d, cap) in share.items()])
    return wide.unpivot("id", list(share), "feature", "value")
