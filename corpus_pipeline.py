"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents;
the last returns the pieces of the packed sequences. Between stages the documents are a Parquet table in the shared
folder, so a lost executor costs a stage at most.

In every stage rows with a null or repeated doc_id stay rows of their own, columns other than doc_id and text are carried
along, and an empty table gives an empty one. Null and empty texts have no words, so the first stage leaves them out;
given to a later stage by itself they are kept by the line stage, are near-duplicates of each other, hold no benchmark
item, and are packed as their end mark alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import decontam, lines, packing, quality, simhash
from tallgrass.llm._common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and whose content lines hold half of their words."""
    return quality.kept(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that are equal or similar to an earlier one; leave out documents of which no word remains."""
    return lines.without_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash candidates, five-word shingles' Jaccard similarity of 0.8) keep one row, of the smallest id."""
    group = simhash.similar_groups(docs, shingle=5)
    first = group.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.row").alias("_row"))
    keyed = docs.withColumn("row_", F.xxhash64("text"))
    return keyed.join(first, keyed["doc_id"].eqNullSafe(first["_id"]) & (keyed["row_"] == first["_row"]), "left_semi").dropDuplicates(["doc_id", "row_"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    row = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit("")))
    found = decontam.contaminated(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row_")).distinct()
    return docs.withColumn("row_", row).join(found, "row_", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.packed_ids(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", pack)]

#: Trained, similarity-joined and tokenized stages are beyond SQL; tests hold the line stage and the operators against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
