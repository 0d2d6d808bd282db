"""Discovery: which files are scanned. Predicates are columns, so they reach the scan where the source allows it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, modified, content of all files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def glob_regex(globs: list[str]) -> str:
    """One regular expression for several globs; * may cross a slash."""
    parts = []
    for g in globs:
        out = ""
        for c in re.split(r"(\*\*/|\*\*|\*|\?)", g):
            out += {"**/": "(?:.*/)?", "**": ".*", "*": ".*", "?": "[^/]"}.get(c, re.escape(c))
        parts.append(out)
    return "^(?:" + "|".join(parts) + ")$"


def selected(files: DataFrame, extensions: list[str], most: int = 0, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Allowed extension (none: dropped), size within most (0: any), not excluded, included."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    keep = ext.isin(extensions)
    if most:
        keep = keep & (F.col("size") <= most)
    if exclude:
        keep = keep & ~F.col("path").rlike(glob_regex(exclude))
    if include:
        keep = keep & F.col("path").rlike(glob_regex(include))
    return files.filter(keep)


def bundled(content: Column, signatures: list[str], within: int = 4096) -> Column:
    head, hit = F.substring(content, 1, within), F.lit(False)
    for s in signatures:
        hit = hit | head.contains(s)
    return hit


def binary(content: Column) -> Column:
    """More than one in a hundred bytes is NUL."""
    nul = F.length(content) - F.length(F.replace(content.cast("string"), F.lit("\0"), F.lit("")))
    return nul * 100 > F.length(content)


def ignore_rules(files: DataFrame) -> DataFrame:
    """Ignore files (dir, text) -> dir, rules: an array, in the order of the lines, of (pattern, allow, folder).

    pattern is a regular expression for a path below dir. Blank lines and those that begin with # are no rules; ! before
    one allows, / after one is for folders only, and one with a / before its end fits from dir on, others at any depth.
    ** crosses folders, * and ? don't.
    """
    x = files.select("dir", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", "")).filter("line <> '' and not startswith(line, '#')")
    allow = F.startswith("line", F.lit("!"))
    body = F.regexp_replace("line", r"^\\?!|^\\(?=#)", "")
    folder = F.endswith(body, F.lit("/"))
    bare = F.regexp_replace(body, "/+$", "")
    held = bare.contains("/")
    q = F.regexp_replace(F.regexp_replace(bare, "^/+", ""), r"([.+^$(){}|\[\]\\])", r"\\$1")
    # the two stars first, by signs that no path has
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, r"\*\*/", "\x01"), r"/\*\*", "\x02"), r"\*\*", "\x03")
    q = F.regexp_replace(F.regexp_replace(q, r"\*", "[^/]*"), r"\?", "[^/]")
    q = F.replace(F.replace(F.replace(q, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit("/.*")), F.lit("\x03"), F.lit(".*"))
    pattern = F.concat(F.lit("^"), F.when(held, "").otherwise("(?:.*/)?"), q, F.lit("$"))
    rules = F.sort_array(F.collect_list(F.struct("n", pattern.alias("pattern"), allow.alias("allow"), folder.alias("folder"))))
    return x.groupBy("dir").agg(rules.alias("r")).select("dir", F.transform("r", lambda v: F.struct(v["pattern"].alias("pattern"), v["allow"].alias("allow"), v["folder"].alias("folder"))).alias("rules"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files (path, ...) that no ignore rule of a folder above them takes out.

    Of all rules that fit a path, the last one of the deepest folder decides; what lies in a folder that is taken out
    cannot be allowed again. Folders are judged once each, whatever the number of files in them: a path meets the rules
    of the folders above it by an equi-join, one row a folder.
    """
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = files.select("path").distinct().select("path", F.explode(upto).alias("step"))
    entries = steps.groupBy("step").agg(F.bool_or(F.col("step") == F.col("path")).alias("file"), F.bool_or(F.col("step") != F.col("path")).alias("folder"))
    own = F.split("step", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(own, 1, i), "/").alias("dir")))
    met = entries.select("step", "folder", F.explode(above).alias("a")).select("step", "folder", "a.depth", "a.dir").join(rules, "dir")
    rest = F.when(F.col("depth") == 0, F.col("step")).otherwise(F.expr("substr(step, length(dir) + 2)"))
    met = met.withColumn("rest", rest)
    fits = F.filter("rules", lambda r: F.rlike(F.col("rest"), r["pattern"]) & (~r["folder"] | F.col("folder")))
    verdict = met.withColumn("last", F.try_element_at(fits, F.lit(-1))).filter("last is not null").groupBy("step").agg(F.max_by("last", "depth").alias("last"))
    out = verdict.filter("not last.allow").select("step")
    gone = steps.join(out, "step", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")
