"""Lines of coverage reports that are read already; reports.py reads whole reports from their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lcov(reports: DataFrame) -> DataFrame:
    """(content) -> path, line, hits, covered. A record runs from SF: to the next SF:."""
    records = reports.select(F.explode(F.split("content", "(?m)^SF:")).alias("r")).filter(F.trim("r") != "")
    r = records.select(F.substring_index("r", "\n", 1).alias("path"), F.regexp_extract_all("r", F.lit(r"(?m)^DA:([0-9]+,[0-9]+)"), 1).alias("d"))
    one = r.select("path", F.explode("d").alias("x")).select("path", F.split("x", ",").alias("x"))
    return one.select("path", F.get("x", 0).cast("long").alias("line"), F.get("x", 1).cast("long").alias("hits")).withColumn("covered", F.col("hits") > 0)


def tarpaulin(reports: DataFrame) -> DataFrame:
    """files[].traces[].{line, stats.Line}; a path may be an array of segments."""
    j = F.from_json("content", "files array<struct<path: array<string>, traces: array<struct<line: long, stats: struct<Line: long>>>>>")
    f = reports.select(F.explode(j["files"]).alias("f")).select(F.array_join("f.path", "/").alias("path"), F.explode("f.traces").alias("t"))
    return f.select("path", F.col("t.line").alias("line"), F.coalesce("t.stats.Line", F.lit(0)).alias("hits")).withColumn("covered", F.col("hits") > 0)


def istanbul(reports: DataFrame) -> DataFrame:
    """Objects by file with a map l of line to hits, or statementMap joined to s by id."""
    kind = "map<string, struct<path: string, l: map<string, long>, statementMap: map<string, struct<start: struct<line: long>>>, s: map<string, long>>>"
    f = reports.select(F.explode(F.from_json("content", kind)).alias("k", "f")).select(F.coalesce("f.path", "k").alias("path"), "f.l", "f.statementMap", "f.s")
    lines = f.select("path", F.explode("l").alias("line", "hits")).select("path", F.col("line").cast("long").alias("line"), "hits")
    made = f.filter("l is null").select("path", "s", F.explode("statementMap").alias("id", "m"))
    made = made.select("path", F.col("m.start.line").alias("line"), F.coalesce(F.element_at("s", F.col("id")), F.lit(0)).alias("hits"))
    return lines.unionByName(made).withColumn("covered", F.col("hits") > 0)


def jacoco(lines: DataFrame) -> DataFrame:
    """(path, nr, mi, ci, mb, cb) rows of the XML's line elements: hits = ci + cb, covered if hits and no missed instruction."""
    hits = F.col("ci") + F.col("cb")
    return lines.select("path", F.col("nr").alias("line"), hits.alias("hits"), ((hits > 0) & (F.col("mi") == 0)).alias("covered"))


def cobertura(lines: DataFrame) -> DataFrame:
    """(path, number, hits, branch, condition) rows: condition-coverage (c/t) raises hits to c."""
    c = F.coalesce(F.regexp_extract("condition", r"\(([0-9]+)/", 1).try_cast("long"), F.lit(0))
    hits = F.greatest(F.col("hits"), c)
    return lines.select("path", F.col("number").alias("line"), hits.alias("hits"), (hits > 0).alias("covered"))
