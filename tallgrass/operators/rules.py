"""Refactoring rules on entities and line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.scores import clamp
from tallgrass.operators import ranges


def _rated(entities: DataFrame, impact: Column, effort: Column, *kept: str) -> DataFrame:
    return entities.select("id", *kept, impact.alias("impact"), effort.alias("effort"), F.greatest(impact / effort, F.lit(0.1)).alias("priority"))


def long_functions(entities: DataFrame, least: float = 50, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, loc, cyclomatic) with loc >= least: impact, effort and priority."""
    impact = F.least(F.col("loc") / 8 + F.col("cyclomatic") / 2, F.lit(10.0))
    return _rated(entities.filter(F.col("loc") >= least), impact, 4 + F.least(F.col("loc") / 70, F.lit(4.0)), *kept)


def complex_conditions(entities: DataFrame, least: int = 4, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, points, operators, cognitive) with as many decision points or operators."""
    hit = entities.filter(F.greatest("points", "operators") >= least)
    return _rated(hit, clamp(1.5 * F.col("cognitive"), 5.0, 10.0), F.lit(3.5), *kept)


def large_types(entities: DataFrame, lines: int = 200, members: int = 12, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, loc, members) with as many lines or members."""
    hit = entities.filter((F.col("loc") >= lines) | (F.col("members") >= members))
    return _rated(hit, clamp(F.col("loc") / 20 + 0.5 * F.col("members"), 5.0, 10.0), F.lit(7.5), *kept)


def duplicates(entities: DataFrame) -> DataFrame:
    """Members of fingerprints held twice or more in a file (id, file, fp): their number and the first."""
    g = entities.groupBy("file", "fp").agg(F.count("*").alias("members"), F.min("id").alias("first")).filter("members >= 2")
    return entities.join(g, ["file", "fp"]).select("id", "file", "members", "first")


def duplicated(entities: DataFrame, least: int = 4, kept: tuple[str, ...] = ()) -> DataFrame:
    """(id, file, fp, loc) of at least so many lines whose fingerprint another of the file has."""
    hit = entities.filter(F.col("loc") >= least)
    several = hit.groupBy("file", "fp").agg(F.count("*").alias("same")).filter("same >= 2").select("file", "fp")
    return _rated(hit.join(several, ["file", "fp"]), clamp(F.col("loc") / 8, 6.0, 10.0), F.lit(5.5), *kept)


def recommendations(entities: DataFrame, least: float = 5.0) -> DataFrame:
    """All four rules on (id, file, s, e, loc, cyclomatic, cognitive, points, operators, members, fp), impact >= least."""
    kept = ("file", "s", "e")
    found = {"extract_method": long_functions(entities, kept=kept), "simplify_conditionals": complex_conditions(entities, kept=kept), "eliminate_duplication": duplicated(entities, kept=kept), "extract_class": large_types(entities, kept=kept)}
    every = None
    for kind, df in found.items():
        df = df.withColumn("kind", F.lit(kind))
        every = df if every is None else every.unionByName(df)
    return every.filter(F.col("impact") >= least)


def file_scores(found: DataFrame, lines: DataFrame) -> DataFrame:
    """min(120 sum(impact) / max(lines, 1), 100) of each file (file, lines); 0 without recommendations."""
    total = found.groupBy("file").agg(F.sum("impact").alias("impact"))
    score = F.least(120 * F.coalesce("impact", F.lit(0.0)) / F.greatest("lines", F.lit(1)), F.lit(100.0))
    return lines.join(total, "file", "left").select("file", score.alias("score"))


def entity_features(entities: DataFrame, found: DataFrame, width: int = 64) -> DataFrame:
    """Of each entity (id, file, s, e): the recommendations that share a line with it, counted, summed and by kind."""
    r = found.select("file", F.col("s").alias("s2"), F.col("e").alias("e2"), "impact", F.col("priority").alias("p"), "kind")
    met = ranges.overlapping(entities.select("id", "file", "s", "e"), r, width)
    kinds = {"extract_method": "n_method", "extract_class": "n_class", "eliminate_duplication": "n_duplicate", "simplify_conditionals": "n_conditional"}
    per = met.groupBy("id").agg(F.count("*").alias("n"), F.sum("impact").alias("total_impact"), F.avg("impact").alias("mean_impact"), F.avg("p").alias("mean_priority"), F.max("p").alias("max_priority"), *[F.count_if(F.col("kind") == k).alias(v) for k, v in kinds.items()])
    out = entities.select("id").join(per, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in per.dtypes if c != "id"])


def overlaps(ranges_: DataFrame, width: int = 64) -> DataFrame:
    """(file, a, b) of ranges (file, id, s, e) that overlap, ends included."""
    y = ranges_.select("file", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return ranges.overlapping(ranges_, y, width).filter(F.col("id") < F.col("b")).select("file", F.col("id").alias("a"), "b")


def located(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, id, name, line) with the entity of that id, else of that name and line."""
    by_id = entities.select(F.col("id"), F.col("id").alias("own"))
    by_name = entities.groupBy("name", F.col("s").alias("line")).agg(F.min("id").alias("other"))
    return wanted.join(by_id, "id", "left").join(by_name, ["name", "line"], "left").select("key", F.coalesce("own", "other").alias("found"))


def children(entities: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, parent, kind): children of the kinds by parent."""
    return entities.filter(F.col("kind").isin(kinds) & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("members"))
