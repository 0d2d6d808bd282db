"""Coverage gaps as rows: cuts at definitions, what the source says, scores, packs by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scores import clamp
from tallgrass.operators import ranges


def central(path: Column) -> Column:
    """How central a file is, by its name: the first that fits. Fixed values."""
    p = F.lower(path)
    has = lambda *words: F.lit(False) if not words else p.contains(words[0]) | has(*words[1:])
    return F.when(has("lib.rs", "main.rs", "__init__.py", "index."), 0.9).when(has("core", "base", "common", "util"), 0.7).when(has("test", "example"), 0.2).otherwise(0.5)


def _outer(gaps: DataFrame) -> DataFrame:
    """Gaps as ranges to join by."""
    return gaps.select(F.col("path").alias("file"), F.col("start").alias("s"), F.col("stop").alias("e"), "path", "start", "stop")


def _points(files: DataFrame) -> DataFrame:
    """The lines of files (path, text) as ranges of one line."""
    x = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("i", "x"))
    line = (F.col("i") + 1).cast("long")
    return x.select("file", line.alias("p_s"), line.alias("p_e"), "x")


def cut(spans: DataFrame, boundaries: DataFrame, least: int = 3) -> DataFrame:
    """Spans (path, start, stop) cut where a definition (path, line) begins inside; pieces of fewer lines go."""
    points = boundaries.select(F.col("path").alias("file"), F.col("line").alias("p_s"), F.col("line").alias("p_e"))
    inner = ranges.contained(_outer(spans), points).filter("p_s > start").select("path", "start", "stop", F.col("p_s").alias("at"))
    starts = spans.select("path", "start", "stop", F.col("start").alias("at")).unionAll(inner).distinct()
    after = F.lead("at").over(Window.partitionBy("path", "start", "stop").orderBy("at"))
    return starts.select("path", F.col("at").alias("start"), F.coalesce(after - 1, F.col("stop")).alias("stop")).filter(F.col("stop") - F.col("start") + 1 >= least)


def described(gaps: DataFrame, files: DataFrame, exported: str, comment: str, failing: str) -> DataFrame:
    """Adds, from the file's lines (path, text): exported and commented (any line of the gap), the share of failing lines, arguments (commas + 1)."""
    x = ranges.contained(_outer(gaps), _points(files))
    commas = F.length("x") - F.length(F.replace("x", F.lit(","), F.lit("")))
    hit = lambda pattern: F.col("x").rlike(pattern)
    return x.groupBy("path", "start", "stop").agg(F.bool_or(hit(exported)).alias("exported"), F.bool_or(hit(comment)).alias("commented"), (F.count_if(hit(failing)) / F.count("*")).alias("failing"), (F.sum(commas) + 1).cast("int").alias("surface"))


def fan_in(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """path, start, stop, fan_in of gaps from their symbols (path, start, stop, name) and the files' lines (path, line, x).

    It is the number of times that the symbols' names stand as words in the file outside the gap, at least the number of
    symbols. Words are indexed by their places once; those inside a gap are found by a range join under (file, name), and
    taken off the file's count.
    """
    names = symbols.select("path", "name").distinct()
    word = lines.select("path", "line", F.explode(F.regexp_extract_all("x", F.lit("([A-Za-z0-9_]+)"), 1)).alias("name"))
    index = word.join(names, ["path", "name"], "left_semi")
    key = F.struct("path", "name")
    total = index.groupBy("path", "name").agg(F.count("*").alias("total"))
    outer = symbols.select("path", "start", "stop", "name").distinct().select(key.alias("file"), F.col("start").alias("s"), F.col("stop").alias("e"), "path", "start", "stop", "name")
    inside = ranges.contained(outer, index.select(key.alias("file"), F.col("line").alias("p_s"), F.col("line").alias("p_e"))).groupBy("path", "start", "stop", "name").agg(F.count("*").alias("inside"))
    n = symbols.groupBy("path", "start", "stop", "name").agg(F.count("*").alias("times"))
    x = n.join(total, ["path", "name"], "left").join(inside, ["path", "start", "stop", "name"], "left")
    rest = F.coalesce("total", F.lit(0)) - F.coalesce("inside", F.lit(0))
    return x.groupBy("path", "start", "stop").agg(F.greatest(F.sum(rest * F.col("times")), F.sum("times")).alias("fan_in"))


def scores(gaps: DataFrame) -> DataFrame:
    """(loc, cyclomatic, cognitive, fan_in, exported, commented, central): .40 size, .20 complexity, .15 fan-in, .10 exports, .10 centrality, .05 for no comment."""
    size = 1 - F.exp(-F.col("loc") / 20.0)
    complexity = 1 - F.exp(-(F.col("cyclomatic") + F.col("cognitive")) / 10.0)
    fan = F.col("fan_in") / (F.col("fan_in") + 5.0)
    # fixed values: the weights and curves
    s = 0.4 * size + 0.2 * complexity + 0.15 * fan + 0.1 * F.col("exported").cast("int") + 0.1 * F.col("central") + 0.05 * (~F.col("commented")).cast("int")
    return gaps.withColumn("score", clamp(s, 0.0, 1.0))


def by_file(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("path").agg(F.sum("loc").alias("gap_loc"), F.avg(F.col("cyclomatic") + F.col("cognitive")).alias("mean_complexity"), F.count("*").alias("gaps"))


def packs(gaps: DataFrame, files: DataFrame) -> DataFrame:
    """Of each file (path, loc) with gaps (path, loc): coverage before and after, the gain there and in all, tests to write, and the order's key."""
    u = gaps.groupBy("path").agg(F.sum("loc").alias("uncovered"), F.count("*").alias("gaps")).join(files, "path")
    before = F.when(F.col("loc") > 0, 1 - F.col("uncovered") / F.col("loc")).otherwise(1.0)
    p = u.withColumn("before", before).withColumn("after", F.least(F.lit(1.0), F.col("before") + F.col("uncovered") / F.greatest("loc", F.lit(1))))
    p = p.withColumn("gain", F.greatest(F.col("after") - F.col("before"), F.lit(0.0))).withColumn("repo_gain", F.col("gain") * F.col("loc") / 10000)
    p = p.withColumn("tests", F.greatest(F.col("gaps"), F.floor(F.col("uncovered") / 5), F.lit(1)))
    return p.select("path", "uncovered", "before", "after", "gain", "repo_gain", "tests", (F.col("repo_gain") / (F.col("tests") + 1)).alias("value"))


def estimated(uncovered: Column, real: Column, form: Column) -> Column:
    """Gaps of a report: half the uncovered lines for XML, those found for LCOV, none for JSON."""
    return F.when(form == "xml", F.greatest(F.floor(uncovered / 2), F.lit(1))).when(form == "lcov", real).otherwise(0)


def entity_coverage(entities: DataFrame, gaps: DataFrame) -> DataFrame:
    """100 (1 - overlap / loc) of each entity (id, file, s, e) by its worst gap (file, s2, e2)."""
    met = ranges.overlapping(entities, gaps)
    shared = F.least("e", "e2") - F.greatest("s", "s2") + 1
    return met.groupBy("id").agg(F.min(100 * (1 - shared / (F.col("e") - F.col("s") + 1))).alias("percent"))


def context(files: DataFrame, gaps: DataFrame, around: int = 2) -> DataFrame:
    """The lines of each gap and some around it, each with its number."""
    wide = gaps.select(F.col("path").alias("file"), F.greatest(F.col("start") - around, F.lit(1)).alias("s"), (F.col("stop") + around).alias("e"), "path", "start", "stop")
    x = ranges.contained(wide, _points(files)).groupBy("path", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("p_s", "x"))).alias("l"))
    return x.select("path", "start", "stop", F.array_join(F.transform("l", lambda r: F.concat(r["p_s"].cast("string"), F.lit(": "), r["x"])), "\n").alias("shown"))
