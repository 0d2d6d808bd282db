"""Reports and small roll-ups: file features, candidates' issues, codes, tasks, merged settings, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scores import clamp, logistic

#: Middle and width of the logistic curve of each file feature.
FILE_CURVES = {"lines_of_code": (300.0, 75.0), "functions_per_file": (12.0, 4.0), "classes_per_file": (2.0, 1.0), "files_per_directory": (7.0, 2.0)}
#: Scores of impacts and efforts of tasks.
IMPACT = {"I3": 3.0, "high": 3.0, "I2": 2.0, "medium": 2.0, "I1": 1.0, "low": 1.0}
EFFORT = {"E3": 0.5, "high": 0.5, "E2": 0.75, "medium": 0.75, "E1": 1.0, "low": 1.0}


def _looked_up(x: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def file_features(files: DataFrame) -> DataFrame:
    """(path, and the four values) -> (path, feature, value, norm)."""
    long = files.select("path", *[F.col(k).cast("double").alias(k) for k in FILE_CURVES]).unpivot("path", list(FILE_CURVES), "feature", "value")
    norm = F.lit(None).cast("double")
    for k, (middle, width) in FILE_CURVES.items():
        norm = F.when(F.col("feature") == k, logistic(F.col("value"), middle, width)).otherwise(norm)
    return long.withColumn("norm", norm)


def confidence(features: DataFrame, known: DataFrame) -> DataFrame:
    """min(n / 10, 1) times the mean confidence of the features known."""
    f = features.join(known, "feature", "left")
    return f.groupBy("id").agg((F.least(F.count("*") / 10, F.lit(1.0)) * F.coalesce(F.avg("weight"), F.lit(0.0))).alias("confidence"))


def candidate_issues(scores: DataFrame, contributions: DataFrame, least: float = 0.5) -> DataFrame:
    """An issue for each category (id, category, score) above ``least`` of an entity with a priority, with its features by name."""
    names = contributions.groupBy("id", "category").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))
    return scores.filter((F.col("priority") != "None") & (F.col("score") > least)).join(names, ["id", "category"], "left").select("id", "category", "score", "features")


def top_categories(issues: DataFrame, k: int) -> DataFrame:
    """The most frequent categories (a report of k rows)."""
    return issues.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def code_health(summary: DataFrame) -> DataFrame:
    """clamp(1 - refactor / entities - min(|mean| / 2, .3)); 1 without entities."""
    h = clamp(1 - F.col("refactor") / F.nullif("entities", F.lit(0)) - F.least(F.abs("mean") / 2, F.lit(0.3)), 0.0, 1.0)
    return summary.withColumn("health", F.when(F.col("entities") == 0, 1.0).otherwise(h))


def suggestions(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """The first suggestion of each code: rules (rank, part, code) whose part the feature's name holds, in the rules' order."""
    hit = issues.join(F.broadcast(rules), F.col("feature").contains(F.col("part")))  # as many rows as the caller has rules
    w = Window.partitionBy("id", "code").orderBy("rank", "feature")
    return hit.withColumn("k", F.row_number().over(w)).filter("k = 1").select("id", "code", "feature")


def codes(kinds: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each kind's first entry of the dictionary (rank, how, part, code): exact, starts or contains."""
    k = F.col("kind")
    fits = F.when(F.col("how") == "exact", k == F.col("part")).when(F.col("how") == "starts", k.startswith(F.col("part"))).otherwise(k.contains(F.col("part")))
    hit = kinds.join(F.broadcast(dictionary), fits)  # as many rows as the dictionary has
    return hit.groupBy("kind").agg(F.min_by("code", "rank").alias("code"))


def tasks(found: DataFrame, k: int) -> DataFrame:
    """impact * effort * required, the k greatest numbered anew (a report); unknown ones count as 1.5 and .75."""
    s = _looked_up(F.col("impact"), IMPACT, 1.5) * _looked_up(F.col("effort"), EFFORT, 0.75) * F.when(F.coalesce("required", F.lit(False)), 1.5).otherwise(1.0)
    top = found.withColumn("score", s).orderBy(F.desc("score"), "id").limit(k)  # k rows are numbered in one task
    return top.withColumn("number", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("number", "id", "score")


def file_priority(path: Column, extension: Column, size: Column, high: list[str], medium: list[str], low: list[str], boosts: dict[str, float], tests: list[str], made: list[str]) -> Column:
    """1 plus boosts by parts of the path and the extension; less for large files, tests and generated ones, more for small ones."""

    def holds(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | path.contains(w)
        return out

    p = F.lit(1.0) + F.when(holds(high), 3.0).otherwise(0.0) + F.when(holds(medium), 2.0).otherwise(0.0) + F.when(holds(low), 1.5).otherwise(0.0) + _looked_up(extension, boosts, 0.0)
    p = p * F.when(size > 50_000, 0.5).when(size > 20_000, 0.7).otherwise(1.0) * F.when(size < 1_000, 1.2).otherwise(1.0)
    return p * F.when(holds(tests), 0.3).otherwise(1.0) * F.when(holds(made), 0.1).otherwise(1.0)


def settings(runs: DataFrame) -> DataFrame:
    """Of each key the value of the last run that had it enabled, else that of the last run."""
    on = F.max_by("value", F.when(F.col("enabled"), F.col("run")))
    return runs.groupBy("key").agg(F.coalesce(on, F.max_by("value", "run")).alias("value"))


def merged_clones(parts: DataFrame, key: str) -> DataFrame:
    """Pairs add, means are weighted by them, the greatest similarity stays the greatest."""
    n = F.sum("pairs")
    return parts.groupBy(key).agg(n.alias("pairs"), F.when(n == 0, F.avg("mean")).otherwise(F.sum(F.col("mean") * F.col("pairs")) / F.nullif(n, F.lit(0))).alias("mean"), F.max("most").alias("most"))


def id_parts(identity: Column) -> dict[str, Column]:
    """Path and name of an id a:b:c: its first part, and the last part behind it that is not a number."""
    parts = F.split(identity, ":")
    named = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.rlike("^[0-9]+$"))
    return {"path": F.get(parts, 0), "name": F.get(named, F.size(named) - 1)}


def included(path: Column, include: str, exclude: str) -> Column:
    """Whether a path is taken: excluding wins, then including, else not."""
    return ~path.rlike(exclude) & path.rlike(include)


def node_key(kind: Column, text: Column) -> Column:
    """kind:text, or the kind alone where the text is blank."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", kind).otherwise(F.concat_ws(":", kind, text))


def outside(lines: Column, start: Column, stop: Column) -> Column:
    """The lines of an array that are not from start to stop (from 1, both included)."""
    return F.filter(lines, lambda x, i: (i + 1 < start) | (i + 1 > stop))


def eligible_documentation(files: DataFrame) -> DataFrame:
    """(dir, file, gaps, lines): of the files with gaps and 50 lines and more, 100 (1 - gaps / eligible) by folder; fewer than five give 100."""
    e = files.filter("gaps > 0 and lines >= 50").groupBy("dir").agg(F.count("*").alias("eligible"), F.sum("gaps").alias("gaps"))
    every = files.select("dir").distinct().join(e, "dir", "left").fillna(0, ["eligible", "gaps"])
    return every.select("dir", "eligible", F.when(F.col("eligible") < 5, 100.0).otherwise(clamp(100 * (1 - F.col("gaps") / F.col("eligible")), 0.0, 100.0)).alias("score"))


def documentation(scores: DataFrame, coverage: float | None) -> DataFrame:
    """One row: the folders' mean score, else the coverage, else 100."""
    return scores.agg(F.coalesce(F.avg("score"), F.lit(coverage).cast("double"), F.lit(100.0)).alias("score"))
