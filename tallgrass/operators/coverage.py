"""Coverage lines (path, line, hits, covered): spans of uncovered lines, merges, scores, joins with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.operators import ranges


def upsert(lines: DataFrame) -> DataFrame:
    """One row for each (path, line): most hits, covered if any report says so."""
    return lines.groupBy("path", "line").agg(F.max("hits").alias("hits"), F.bool_or("covered").alias("covered"))


def spans(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive uncovered lines: path, start, stop."""
    gap = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    runs = lines.filter(~F.col("covered")).withColumn("run", gap)
    return runs.groupBy("path", "run").agg(F.min("line").alias("start"), F.max("line").alias("stop")).filter(F.col("stop") - F.col("start") + 1 >= least).select("path", "start", "stop")


def merged(spans_: DataFrame, reach: int = 2) -> DataFrame:
    """Spans whose starts are within reach of an earlier end become one."""
    w = Window.partitionBy("path").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans_.withColumn("new", F.coalesce((F.col("start") > before + reach).cast("int"), F.lit(1)))
    s = s.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("path", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("parts")).drop("island")


def percent(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.count("*").alias("lines"), (100 * F.avg(F.col("covered").cast("int"))).alias("percent"))


def contained(spans_: DataFrame, points: DataFrame, width: int = 64) -> DataFrame:
    """Decision points (path, line, nesting) inside each span: cyclomatic 1 + n and cognitive sum(1 + nesting), 0 if none."""
    s = spans_.select(F.col("path").alias("file"), F.col("start").alias("s"), F.col("stop").alias("e"))
    p = points.select(F.col("path").alias("file"), F.col("line").alias("p_s"), F.col("line").alias("p_e"), "nesting")
    n = ranges.contained(s, p, width).groupBy(F.col("file").alias("path"), F.col("s").alias("start"), F.col("e").alias("stop")).agg((1 + F.count("*")).alias("c"), F.sum(1 + F.col("nesting")).alias("g"))
    zero = F.lit(0).cast("long")
    return spans_.select("path", "start", "stop").join(n, ["path", "start", "stop"], "left").select("path", "start", "stop", F.coalesce("c", zero).alias("cyclomatic"), F.coalesce("g", zero).alias("cognitive"))


def gap_scores(gaps: DataFrame) -> DataFrame:
    """.40 size + .20 complexity + .15 fan-in, each on a saturating curve, plus .05 for missing documents."""
    # fixed values: the weights and curves
    size = 1 - F.exp(-F.col("loc") / 20.0)
    complexity = 1 - F.exp(-F.col("cognitive") / 10.0)
    fan = F.col("fan_in") / (F.col("fan_in") + 5.0)
    return gaps.withColumn("score", F.least(F.lit(1.0), 0.4 * size + 0.2 * complexity + 0.15 * fan + 0.05 * F.col("undocumented").cast("int")))


def with_fallback(entities: DataFrame, exact: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, start, stop): coverage of exactly that range, else one that overlaps by half, else the file's."""
    e = entities.join(exact.withColumnRenamed("percent", "own"), ["path", "start", "stop"], "left")
    x = exact.select(F.col("path").alias("file"), F.col("start").alias("s2"), F.col("stop").alias("e2"), F.col("percent").alias("p"))
    shared = F.least("e", "e2") - F.greatest("s", "s2") + 1
    met = ranges.overlapping(entities.select("id", F.col("path").alias("file"), F.col("start").alias("s"), F.col("stop").alias("e")), x)
    near = met.filter(2 * shared >= F.col("e") - F.col("s") + 1)
    near = near.groupBy("id").agg(F.min("p").alias("near"))
    out = e.join(near, "id", "left").join(files.select("path", F.col("percent").alias("whole")), "path", "left")
    level = F.when(F.col("own").isNotNull(), "range").when(F.col("near").isNotNull(), "overlap").when(F.col("whole").isNotNull(), "file").otherwise("none")
    return out.select("id", F.coalesce("own", "near", "whole").alias("percent"), level.alias("level"))
