"""Coverage reports of five formats, recognised and read from their own text.

Reports are (report, content): a path and the whole text of one. What cannot be read is a row of failures(), with its
reason, and no error: one damaged report does not stop the others.

Lists are taken apart by explode_outer, as the filter that Spark infers for explode would parse each text a second time;
rows without a line are left out at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.session import written

LCOV, COVERAGE_PY, COBERTURA, JACOCO, ISTANBUL, TARPAULIN, UNKNOWN = "lcov", "coverage.py", "cobertura", "jacoco", "istanbul", "tarpaulin", "unknown"
#: Objects within objects in which a JSON report's files are looked for.
DEPTH = 4

_LINE = "array<struct<_number: string, _hits: string, `_condition-coverage`: string, _branch: string>>"
_CLASS = f"array<struct<_filename: string, _name: string, lines: struct<line: {_LINE}>, methods: struct<method: array<struct<lines: struct<line: {_LINE}>>>>>>"
_PACKAGE = f"array<struct<_name: string, _path: string, classes: struct<class: {_CLASS}>>>"
_COBERTURA = f"packages struct<package: {_PACKAGE}>"
_SOURCE = "array<struct<_name: string, line: array<struct<_nr: string, _mi: string, _ci: string, _cb: string>>>>"
_JPACKAGE = f"array<struct<_name: string, sourcefile: {_SOURCE}>>"
_JACOCO = f"package {_JPACKAGE}, `group` array<struct<package: {_JPACKAGE}>>"
_TARPAULIN = "files array<struct<path: string, traces: array<struct<line: long, stats: struct<Line: long>>>>>"
_ISTANBUL = "path string, file string, url string, l string, lines string, statementMap string, s string"


def sniffed(reports: DataFrame) -> DataFrame:
    """The reports with their format: by the file's name, else by the first 1024 characters; JSON by up to 65,536.

    A null content is unknown, as is a text with a NUL among its first characters.
    """
    name = F.regexp_replace("report", "^.*/", "")
    head = F.lower(F.substring("content", 1, 1024))
    near, far = F.substring("content", 1, 1024), F.substring("content", 1, 65536)
    json = F.when((near.contains('"files"') & near.contains('"path":[')) | (far.contains('"files"') & far.contains('"traces"')), TARPAULIN).otherwise(ISTANBUL)
    xml = F.when(head.contains("coverage") & head.contains("branch-rate"), COBERTURA).when(head.contains("coverage"), COVERAGE_PY).when(head.contains("report") & head.contains("package"), JACOCO).otherwise(UNKNOWN)
    by_text = F.when(head.contains("\0"), UNKNOWN).when(head.contains("<?xml"), xml).when(head.rlike(r"(^|\n)(tn:|sf:)"), LCOV).when(head.startswith("{") & head.contains('"path"'), ISTANBUL).otherwise(UNKNOWN)
    kind = F.when(F.col("content").isNull(), UNKNOWN).when(name.contains("coverage") & name.endswith(".xml"), COVERAGE_PY).when(name.endswith("lcov.info") | name.endswith(".lcov"), LCOV)
    kind = kind.when(name.contains("cobertura") & name.endswith(".xml"), COBERTURA).when(name.endswith(".json"), json).otherwise(by_text)
    return reports.withColumn("format", kind)


def file_name(path: Column) -> Column:
    """A file's path as reports write it, without quotes around it and a leading ./, with slashes."""
    bare = F.regexp_replace(F.trim(path), '^"+|"+$', "")
    return F.translate(F.regexp_replace(bare, r"^\./", ""), "\\", "/")


def _whole(column: Column) -> Column:
    return F.coalesce(F.when(column.rlike(r"^\+?[0-9]+$"), column.try_cast("long")), F.lit(0))


def _lines(x: DataFrame, file: Column, line: Column, hits: Column, covered: Column) -> DataFrame:
    x = x.filter(file.isNotNull() & line.isNotNull())
    return x.select("report", "format", file_name(file).alias("file"), line.cast("long").alias("line"), hits.alias("hits"), covered.alias("covered"))


def _lcov(r: DataFrame) -> DataFrame:
    parts = r.select("report", "format", F.explode_outer(F.split("content", r"(?m)^SF:")).alias("part"), F.lit(0)).withColumn("d", F.regexp_extract_all("part", F.lit(r"(?m)^DA:([0-9]+,[0-9]+)"), 1))
    x = parts.select("report", "format", F.trim(F.regexp_extract("part", r"^([^\r\n]*)", 1)).alias("file"), F.explode_outer("d").alias("d")).filter("file <> ''")
    hits = F.substring_index("d", ",", -1).try_cast("long")
    return _lines(x, F.col("file"), F.substring_index("d", ",", 1).try_cast("long"), hits, hits > 0)


def _cobertura(r: DataFrame) -> DataFrame:
    p = r.select("report", "format", F.explode_outer("c.packages.package").alias("p")).select("report", "format", F.coalesce("p._name", "p._path").alias("package"), F.explode_outer("p.classes.class").alias("k"))
    name = F.coalesce("k._filename", "k._name")
    file = F.when(F.col("package").isNotNull() & ~name.rlike(r"[/\\]"), F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/"), name)).otherwise(name)
    none = F.expr(f"cast(array() as {_LINE})")
    every = F.concat(F.coalesce("k.lines.line", none), F.coalesce(F.flatten(F.transform(F.filter("k.methods.method", lambda m: m["lines"]["line"].isNotNull()), lambda m: m["lines"]["line"])), none))
    x = p.select("report", "format", file.alias("file"), F.explode_outer(every).alias("x"))
    met = F.coalesce(F.regexp_extract("x.`_condition-coverage`", r"\(\s*([0-9]+)\s*/\s*[0-9]+\s*\)", 1).try_cast("long"), F.lit(0))
    hits = F.greatest(_whole(F.col("x._hits")), met)  # conditions met count as hits; a branch without any is not covered
    return _lines(x, F.col("file"), F.col("x._number").try_cast("long"), hits, hits > 0)


def _jacoco(r: DataFrame) -> DataFrame:
    none = F.expr(f"cast(array() as {_JPACKAGE})")
    every = F.concat(F.coalesce("j.package", none), F.coalesce(F.flatten(F.transform(F.filter("j.group", lambda g: g["package"].isNotNull()), lambda g: g["package"])), none))
    s = r.select("report", "format", F.explode_outer(every).alias("p")).select("report", "format", "p._name", F.explode_outer("p.sourcefile").alias("s"))
    file = F.concat(F.coalesce(F.concat(F.replace("_name", F.lit("."), F.lit("/")), F.lit("/")), F.lit("")), F.col("s._name"))
    x = s.select("report", "format", file.alias("file"), F.explode_outer("s.line").alias("x"))
    hits = _whole(F.col("x._ci")) + _whole(F.col("x._cb"))
    return _lines(x, F.col("file"), F.col("x._nr").try_cast("long"), hits, (hits > 0) & (_whole(F.col("x._mi")) == 0))


def _tarpaulin(r: DataFrame) -> DataFrame:
    f = r.select("report", "format", F.explode_outer("t.files").alias("f"))
    segments = F.from_json("f.path", "array<string>")  # a path is a list of its parts or one string
    x = f.select("report", "format", F.when(F.startswith("f.path", F.lit("[")), F.array_join(segments, "/")).otherwise(F.col("f.path")).alias("file"), F.explode_outer("f.traces").alias("x"))
    hits = F.coalesce("x.stats.Line", F.lit(0))
    return _lines(x, F.col("file"), F.col("x.line"), hits, hits > 0)


def _inner(x: Column) -> Column:
    """The objects and lists that are values of a JSON object or list, as texts. One without a further bracket or an escape has none."""
    values = F.when(F.startswith(F.ltrim(x), F.lit("[")), F.from_json(x, "array<string>")).otherwise(F.map_values(F.from_json(x, "map<string,string>")))
    return F.coalesce(F.when(x.rlike(r"(?s)^.*?[\[{].*[\[{\\]"), F.filter(values, lambda v: F.ltrim(v).rlike(r"^[\[{]"))), F.array().cast("array<string>"))


def _istanbul(r: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Objects with a path, file or url, at any place within ``depth`` objects or lists, each with the lines' hits.

    Each level is taken from the one above in the report's own row, so that none is parsed again for those below it.
    """
    levels = r.select("report", "format", F.array("content").alias("x0"))
    for k in range(depth):
        levels = levels.withColumn(f"x{k + 1}", F.flatten(F.transform(f"x{k}", _inner)))
    # an object without these words, or an escape that may stand for one, is no file
    every = F.filter(F.concat(*[F.col(f"x{k}") for k in range(depth + 1)]), lambda x: x.rlike(r"path|file|url|\\"))
    found = levels.select("report", "format", F.explode_outer(F.transform(every, lambda x: F.from_json(x, _ISTANBUL))).alias("o"))
    file = F.coalesce("o.path", "o.file", "o.url")
    found = written(found.filter(file.isNotNull()).select("report", "format", file.alias("file"), "o"), "found")
    l = F.coalesce("o.l", "o.lines")  # noqa: E741
    m = found.select("report", "format", "file", F.explode_outer(F.from_json(l, "map<string,long>")).alias("line", "hits"))
    a = found.filter(F.startswith(l, F.lit("["))).select("report", "format", "file", F.posexplode_outer(F.from_json(l, "array<long>")).alias("at", "hits")).filter("hits is not null")
    s = found.filter(l.isNull()).select("report", "format", "file", F.from_json("o.s", "map<string,long>").alias("s"), F.explode_outer(F.from_json("o.statementMap", "map<string,struct<start: struct<line: long>>>")).alias("id", "at"))
    hits = F.col("hits")
    n = F.coalesce(F.element_at("s", F.col("id")), F.lit(0))
    return _lines(m, F.col("file"), F.col("line").try_cast("long"), hits, hits > 0).unionAll(_lines(a, F.col("file"), F.col("at") + 1, hits, hits > 0)).unionAll(_lines(s, F.col("file"), F.col("at.start.line"), n, n > 0))


#: A schema that only tells whether a text can be read.
_BAD = "_corrupt_record string"


def _bad(content: Column, kind: Column) -> Column:
    """Whether a text of the kind is no XML or JSON."""
    xml = F.from_xml(F.when(kind.isin(COBERTURA, COVERAGE_PY, JACOCO), content), _BAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    json = F.when(kind.isin(ISTANBUL, TARPAULIN), content)
    odd = json.isNotNull() & F.from_json(json, "map<string,string>").isNull() & F.from_json(json, "array<string>").isNull()
    return F.coalesce(xml["_corrupt_record"].isNotNull() | odd, F.lit(False))


def lines(reports: DataFrame) -> DataFrame:
    """report, format, file, line, hits, covered: of a line that a report names several times the most hits, covered if once covered."""
    x = sniffed(reports)
    # all rows are written, as a filter would work out the format, and what the texts are made of, again for each place it is named
    x = written(x.withColumn("content", F.when(F.col("format") != UNKNOWN, F.col("content"))), "reports")
    of = lambda *kinds: x.filter(F.col("format").isin(*kinds) & ~_bad(F.col("content"), F.col("format")))
    cobertura = of(COBERTURA, COVERAGE_PY).withColumn("c", F.from_xml("content", _COBERTURA))
    jacoco, tarpaulin = of(JACOCO).withColumn("j", F.from_xml("content", _JACOCO)), of(TARPAULIN).withColumn("t", F.from_json("content", _TARPAULIN))
    every = _lcov(of(LCOV)).unionAll(_cobertura(cobertura)).unionAll(_jacoco(jacoco)).unionAll(_tarpaulin(tarpaulin)).unionAll(_istanbul(of(ISTANBUL)))
    return every.groupBy("report", "format", "file", "line").agg(F.max("hits").alias("hits"), F.bool_or("covered").alias("covered"))


def failures(reports: DataFrame) -> DataFrame:
    """report, format, reason of the reports that cannot be read: unknown formats, and texts that are no XML or JSON."""
    x = sniffed(reports)
    reason = F.when(F.col("format") == UNKNOWN, "unknown format").when(_bad(F.col("content"), F.col("format")), "damaged")
    return x.select("report", "format", reason.alias("reason")).filter("reason is not null")
