"""Statistics that are kept by group and worked out again only where files changed.

A view is a folder of Parquet tables in the shared store: ``groups`` (one row a group: signature, files, when) and
``rows`` (what was worked out, partitioned by a group's version). A refresh takes the groups' signatures of now, works out
those that are new, changed or too old, reading the files of these groups alone, writes the next version of both tables
beside the ones in use and then moves one small pointer, so readers see the old state or the new one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which a group is worked out again; share of changed files up to which it is left.
MAX_AGE, SMALL_CHANGE = 7 * 24 * 3600, 0.05
#: A change of unknown size counts as this share of a group's files.
UNKNOWN_CHANGE = 0.5


def signatures(files: DataFrame) -> DataFrame:
    """(grp, path, mark) -> grp, signature, files: a sum over the files' hashes, so neither order nor one task's memory matters.

    mark tells one state of a file from another (its text's hash, or size and time). Two sums of different 64-bit hashes are kept.
    """
    both = [F.sum(F.xxhash64("path", "mark", F.lit(k)).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    return files.groupBy("grp").agg(F.concat_ws(":", *both).alias("signature"), F.count("*").alias("files"))


class View:
    """A kept view below ``path``; ``work`` makes rows with a column grp from files (grp, path, mark, ...)."""

    def __init__(self, spark: SparkSession, path: str, work: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.work = spark, path.rstrip("/"), work
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The version in use, 0 if there is none."""
        if not self._fs.exists(self._at("current")):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._at("current"))), default=0)

    def _table(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{version}")

    def groups(self) -> DataFrame:
        return self._table("groups", self.version())

    def rows(self) -> DataFrame:
        """What is kept now."""
        return self._table("rows", self.version())

    def stale(self, files: DataFrame, now: float, most_age: float = MAX_AGE, small: float = SMALL_CHANGE, changed: Column | None = None) -> DataFrame:
        """grp of the groups to be worked out: new, older than most_age, or changed by more than ``small``.

        How much of a changed group's files changed is not known from its signature, so it counts as a half; ``changed``,
        a column over (old files n, new files files), may say otherwise. Groups that are gone are not in it.
        """
        new = signatures(files)
        if not self.version():
            return new.select("grp")
        old = self.groups().select("grp", F.col("signature").alias("was"), F.col("files").alias("n"), "made")
        share = F.when(F.col("was") == F.col("signature"), 0.0).otherwise(F.lit(UNKNOWN_CHANGE) if changed is None else changed)
        met = new.join(old, "grp", "left")
        return met.filter(F.col("was").isNull() | (F.col("made") < now - most_age) | (share > small)).select("grp")

    def refresh(self, files: DataFrame, now: float | None = None, most_age: float = MAX_AGE, small: float = SMALL_CHANGE) -> int:
        """Bring the view up to date; the number of groups worked out. Groups without files are left out from now on."""
        now, old, spark = time.time() if now is None else now, self.version(), self.spark
        due = f"{self.path}/due/{old + 1}"
        self.stale(files, now, most_age, small).write.mode("overwrite").parquet(due)
        stale = spark.read.parquet(due)
        n, signed = stale.count(), signatures(files)
        gone = old and not self.groups().join(signed, "grp", "left_anti").isEmpty()
        if old and not n and not gone:
            return 0
        fresh = self.work(files.join(stale, "grp", "left_semi"))
        made = signed.join(stale, "grp", "left_semi").withColumn("made", F.lit(float(now)))
        if old:
            left = self.groups().join(signed.select("grp"), "grp", "left_semi").join(stale, "grp", "left_anti")
            made = made.unionByName(left)
            fresh = fresh.unionByName(self.rows().join(left.select("grp"), "grp", "left_semi"))
        for name, table in (("rows", fresh), ("groups", made)):
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/{old + 1}")
        # readers go over by the last step, which is one new name
        self._fs.mkdirs(self._at(f"current/{old + 1}"))
        for k in range(1, old):  # those who read the last version may go on
            for name in ("rows", "groups", "due", "current"):
                self._fs.delete(self._at(f"{name}/{k}"), True)
        return n
