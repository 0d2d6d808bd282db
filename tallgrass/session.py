"""Session defaults and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallgrass", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). One is made only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallgrass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: worked out once, and not lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a written() table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it is read in fewer partitions than there are (a small file of one row group).

    For tables whose rows cost much work, such as texts; a large table stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, *keys: str, each: int = 8) -> DataFrame:
    """df dealt out by its keys into ``each`` tasks for one of reading its files, so that a task's memory does not grow with them."""
    spark, files = df.sparkSession, df.inputFiles()
    read = spark.read.text(files).rdd.getNumPartitions() if files else 1  # counted by the files' sizes, without reading them
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * read), *keys)
