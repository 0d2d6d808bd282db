"""Imports resolved to files by ranked keys: an equi-join on every form that a file or an import may be written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of source files; stems that name no module.
EXTENSIONS, NO_STEMS = ("rs", "py", "js", "ts", "tsx", "jsx", "go"), ("mod", "lib", "main")
#: Ranks after those of prefixes: a file beside the importing one, below its folder, or of the last segment's name.
BESIDE, BELOW, LAST = 1_000_000, 1_000_001, 1_000_002


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def module(path: Column) -> Column:
    """A path as a module's name: without src/, with :: between its parts."""
    return F.replace(F.regexp_replace(path, "^src/", ""), F.lit("/"), F.lit("::"))


def module_keys(files: DataFrame) -> DataFrame:
    """(path) -> key, target: all names a file can be imported by. Of files with the same key the least path has it."""
    p = F.col("path")
    bare = F.regexp_replace(p, rf"\.({'|'.join(EXTENSIONS)})$", "")
    ends = lambda *e: p.rlike(rf"\.({'|'.join(e)})$")
    empty = F.array().cast("array<string>")

    def forms(m: Column) -> Column:
        dots = F.replace(m, F.lit("::"), F.lit("."))
        return F.array(m, dots, F.concat(F.lit("crate::"), m), F.concat(F.lit("crate."), dots))

    stem = F.regexp_replace(F.regexp_replace(p, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    keys = F.concat(
        forms(module(bare)),
        F.when(F.endswith(p, F.lit("mod.rs")), forms(module(folder(p)))).otherwise(empty),
        F.when(~stem.isin(*NO_STEMS), F.array(stem)).otherwise(empty),
        F.when(ends("ts", "tsx", "js", "jsx"), F.array(F.concat(F.lit("./"), F.regexp_replace(bare, "^src/", "")))).otherwise(empty),
        F.when(ends("py"), F.array(F.replace(bare, F.lit("/"), F.lit(".")))).otherwise(empty),
        F.when(ends("go"), F.array(folder(p))).otherwise(empty),
    )
    return files.select("path", F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.min("path").alias("target"))


def normalized(name: Column, path: Column) -> Column:
    """An import's name with dots, after crate, super and self have been read from the importing file's place."""
    up = folder(path)
    # super:: needs two folders above the file, of which the upper one may be the root
    parent = F.when(up != "", F.concat(module(folder(up)), F.lit("::"), F.regexp_replace(name, "^super::", ""))).otherwise(name)
    own = F.concat(module(up), F.lit("::"), F.regexp_replace(name, "^self::", ""))
    n = F.when(F.startswith(name, F.lit("super::")), parent).when(F.startswith(name, F.lit("self::")), own).otherwise(name)
    return F.regexp_replace(F.replace(F.replace(n, F.lit("::"), F.lit(".")), F.lit("/"), F.lit(".")), r"^\.+", "")


def asked_keys(imports: DataFrame) -> DataFrame:
    """(path, name) -> path, name, key, rank: every key that may answer an import, the better ones with lower ranks.

    The whole name with dots, then with ::, then each shorter prefix in both forms; of a name of one part a file beside
    the importing one, then one below its folder; last the last part alone.
    """
    parts = F.split("normal", r"\.")
    n = F.size("parts")
    x = imports.select("path", "name", normalized(F.col("name"), F.col("path")).alias("normal")).withColumn("parts", parts)

    def forms(i: Column) -> Column:
        p = F.slice("parts", 1, n - i)
        return F.array(F.struct(F.array_join(p, ".").alias("key"), (2 * i).alias("rank")), F.struct(F.array_join(p, "::").alias("key"), (2 * i + 1).alias("rank")))

    one, up = F.element_at("parts", 1), folder(F.col("path"))
    beside = F.array(F.struct(F.concat(up, F.lit("."), one).alias("key"), F.lit(BESIDE).alias("rank")), F.struct(F.concat(module(up), F.lit("::"), one).alias("key"), F.lit(BELOW).alias("rank")))
    none = F.filter(beside, lambda k: F.lit(False))
    keys = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), forms)), F.when(n == 1, beside).otherwise(none), F.array(F.struct(F.element_at("parts", -1).alias("key"), F.lit(LAST).alias("rank"))))
    return x.select("path", "name", F.explode(keys).alias("k")).select("path", "name", "k.key", "k.rank")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, target, rank of the imports (path, name) that a file answers, each by the key of least rank.

    Keys meet by equality, so no import is compared with a file that does not bear one of its names; a prefix that many
    imports share is joined to the one file that bears it. Equal imports of a file give one row; null names give none.
    """
    # both sides are made from small columns and grow when exploded, so Spark takes them for smaller than they are
    met = asked_keys(imports.filter("name is not null").distinct()).join(module_keys(files).hint("merge"), "key")
    best = met.groupBy("path", "name").agg(F.min(F.struct("rank", "target")).alias("b"))
    return best.select("path", "name", F.col("b.target").alias("target"), F.col("b.rank").cast("long").alias("rank"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: a file and one that it imports, once for each import; a file does not import itself."""
    return resolved(imports, files).filter("path <> target").select(F.col("path").alias("src"), F.col("target").alias("dst"))
