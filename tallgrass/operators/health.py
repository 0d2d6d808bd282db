"""Health roll-ups and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.scores import clamp
from tallgrass.session import written

#: Weights of maintainability, structure, complexity, debt and documentation.
WEIGHTS = (0.28, 0.25, 0.18, 0.19, 0.10)
#: Rule, metric, comparison and limit of the default gates.
GATES = [("health", "health", "<", 60.0), ("complexity", "complexity", ">", 70.0), ("debt", "debt", ">", 50.0), ("maintainability", "maintainability", "<", 20.0), ("issues", "issues", ">", 5.0), ("critical", "critical", ">", 0.0)]


def overall(mi: Column, structure: Column, complexity: Column, debt: Column, docs: Column) -> Column:
    a, b, c, d, e = WEIGHTS
    return clamp(a * mi + b * structure + c * (100 - complexity) + d * (100 - debt) + e * docs, 0.0, 100.0)


def _means() -> dict[str, Column]:
    mean = lambda c, empty: F.coalesce(F.avg(c), F.lit(empty))
    return {"mi": mean("maintainability", 100.0), "cx": F.least(4 * (mean("cyclomatic", 0.0) + mean("cognitive", 0.0)) / 2, F.lit(100.0)), "debt": mean("debt", 0.0)}


def project(entities: DataFrame, structure_issues: Column, docs: Column) -> DataFrame:
    """One row of health parts and their weighted sum, from (cyclomatic, cognitive, debt, maintainability)."""
    m = entities.agg(*[v.alias(k) for k, v in _means().items()])
    structure = F.greatest(100 - 5 * structure_issues, F.lit(0.0))
    return m.select(F.col("cx").alias("complexity"), "debt", F.col("mi").alias("maintainability"), structure.alias("structure"), docs.alias("docs"), overall(F.col("mi"), structure, F.col("cx"), F.col("debt"), docs).alias("health"))


def levels(entities: DataFrame) -> DataFrame:
    """Health by dir, by file and by entity in one pass over (dir, file, id, metrics); a missing metric counts as healthy."""
    sets = [["dir"], ["dir", "file"], ["dir", "file", "id"]]
    g = entities.groupingSets(sets, "dir", "file", "id").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"), *[v.alias(k) for k, v in _means().items()])
    level = F.when(F.col("gid") == 0, "entity").when(F.col("gid") == 1, "file").otherwise("dir")
    return g.select("dir", "file", "id", level.alias("level"), "n", overall(F.col("mi"), F.lit(100.0), F.col("cx"), F.col("debt"), F.lit(100.0)).alias("health"))


def from_scores(scores: DataFrame) -> DataFrame:
    """Health parts from the mean absolute score; all well if there is none."""
    m = scores.agg(F.coalesce(F.avg(F.abs("overall")), F.lit(0.0)).alias("a"))
    c = lambda x: clamp(x, 0.0, 100.0)
    a = F.col("a")
    return m.select(c(100 - 18 * a).alias("maintainability"), c(25 * a).alias("debt"), c(30 * a).alias("complexity"), c(100 - 12 * a).alias("structure"))


def ancestors(path: Column) -> Column:
    """The folders above a path a/b/c: a/b and a, and the root as an empty name."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def tree(files: DataFrame, least: float = 0.8) -> DataFrame:
    """Folders of files (path, health): parent, own files, mean health (0 for a folder without files of its own), those below ``least``.

    The root's health is the mean over all files.
    """
    own = files.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    direct = own.groupBy("dir").agg(F.count("*").alias("files"), F.avg("health").alias("health"), F.count_if(F.col("health") < least).alias("needing"))
    every = files.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    mean = files.agg(F.avg("health").alias("root"))  # one row
    out = every.join(direct, "dir", "left").crossJoin(F.broadcast(mean))
    zero = F.lit(0).cast("long")
    return out.select("dir", F.when(F.col("dir") != "", F.regexp_replace("dir", "/?[^/]*$", "")).alias("parent"), F.coalesce("files", zero).alias("files"), F.when(F.col("dir") == "", F.col("root")).otherwise(F.coalesce("health", F.lit(0.0))).alias("health"), F.coalesce("needing", zero).alias("needing"))


def from_candidates(candidates: DataFrame) -> DataFrame:
    """(path, overall) -> path and health: clamp((100 - mean) / 100)."""
    return candidates.groupBy("path").agg(clamp((100 - F.avg("overall")) / 100, 0.0, 1.0).alias("health"))


def overlaid(health: DataFrame, newer: DataFrame) -> DataFrame:
    """(path, health) with newer values where there are some, and the mean of all."""
    out = health.join(newer.withColumnRenamed("health", "new"), "path", "left").select("path", F.coalesce("new", "health").alias("health"))
    mean = out.agg(F.avg("health").alias("mean"))  # one row
    return out.crossJoin(F.broadcast(mean))


def summary(entities: DataFrame, files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, entities, lines, languages (sorted), issues by severity, and 1 - min(issues / entities, 1)."""
    e = entities.agg(F.count("*").alias("entities"), F.coalesce(F.sum("loc"), F.lit(0)).alias("lines"))
    f = files.agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))  # few languages
    i = issues.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity").isin("Critical", "High")).alias("high"))
    one = e.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(i))  # rows of one each
    return one.withColumn("health", F.when(F.col("entities") == 0, 1.0).otherwise(1 - F.least(F.col("issues") / F.greatest("entities", F.lit(1)), F.lit(1.0))))


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of metrics against rules (rule, metric, op, threshold): value and whether it violates the rule."""
    long = metrics.unpivot([], metrics.columns, "metric", "value")
    v = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return rules.join(long, "metric").select("rule", "value", "threshold", v.alias("violated"))


def gate_severity(value: Column, threshold: Column) -> Column:
    """How far beyond its limit a value lies: twice, by half, or less."""
    far = F.abs(value - threshold) / F.greatest(F.abs(threshold), F.lit(1.0))
    return F.when(far >= 1, "Critical").when(far >= 0.5, "High").otherwise("Medium")


def worst_files(candidates: DataFrame, k: int = 5) -> DataFrame:
    """The first files by (priority, score) of their worst candidate (file, rank, overall); a report of k rows."""
    return candidates.groupBy("file").agg(F.max(F.struct("rank", "overall")).alias("w")).select("file", "w.rank", "w.overall").orderBy(F.desc("rank"), F.desc("overall"), "file").limit(k)


def folder_tree(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Each folder (path, health or null) with its health, and those of its children that count, worked out from the leaves up.

    files (path, health) are children of the folder that their path names. A folder without a health of its own has the
    mean of its children's healths above 0, or 0 if it has none; folders' computed healths count for their parents, so
    levels follow one another from the deepest to the highest, each in one join of one level's rows. Folders that only
    files or other folders' paths name are not added; a path is given once.
    """
    depth = F.size(F.split("path", "/"))
    up = F.regexp_replace("path", "/?[^/]*$", "")
    d = written(folders.select("path", "health", depth.alias("depth"), up.alias("up")), "folders")
    scores = files.filter("health > 0").groupBy(up.alias("path")).agg(F.sum("health").alias("s"), F.count("*").alias("c"))
    scores = written(scores, "scores")
    made, below, most = [], None, d.agg(F.max("depth")).first()[0] or 0
    for level in range(most, 0, -1):
        x = d.filter(F.col("depth") == level).join(scores, "path", "left").select("path", "up", "health", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("c", F.lit(0)).alias("c"))
        if below is not None:
            b = below.filter("health > 0").groupBy(F.col("up").alias("path")).agg(F.sum("health").alias("s2"), F.count("*").alias("c2"))
            x = x.join(b, "path", "left").select("path", "up", "health", (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s"), (F.col("c") + F.coalesce("c2", F.lit(0))).alias("c"))
        mean = F.when(F.col("c") > 0, F.col("s") / F.col("c")).otherwise(0.0)
        below = written(x.select("path", "up", F.coalesce("health", mean).alias("health"), F.col("c").alias("children"), F.col("health").isNull().alias("computed")), "level")
        made.append(below)
    if not made:
        return d.select("path", "health", F.lit(0).cast("long").alias("children"), F.lit(False).alias("computed"))
    return reduce(DataFrame.unionAll, made).select("path", "health", "children", "computed")
