"""Report rows for writers: issue tables and severities; written by Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SONAR = {"Critical": "BLOCKER", "VeryHigh": "CRITICAL", "High": "MAJOR", "Medium": "MINOR"}


def sonar_severity(severity: Column) -> Column:
    out = F.lit("INFO")
    for k, v in SONAR.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def issue_rows(issues: DataFrame) -> DataFrame:
    """File, Issue Type, Severity, Description, Line, Impact, Effort; severity from priority."""
    sev = F.when(F.col("priority") > 0.8, "High").when(F.col("priority") > 0.5, "Medium").otherwise("Low")
    return issues.select(F.col("file").alias("File"), F.col("kind").alias("Issue Type"), sev.alias("Severity"), F.col("description").alias("Description"), F.col("line").alias("Line"), F.col("impact").alias("Impact"), F.col("effort").alias("Effort"))


def write(df: DataFrame, kind: str, path: str) -> None:
    """csv with a header, json lines, or parquet."""
    w = df.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).csv(path), "jsonl": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[kind]()
