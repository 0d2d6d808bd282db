"""The pipeline's stages and two operators on empty tables, odd rows and columns with clashing names."""

import corpus_pipeline as stages
from pyspark.sql import functions as F

from tallgrass.llm import decontam, urls

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(60))
EXTRA = ["row", "row_", "_id", "_row", "sh", "component", "k", "line", "n", "fp", "tile", "label"]


def test_empty_tables(spark, docs):
    d = docs([])
    for stage in (stages.line_dedup, stages.near_dedup, stages.decontamination):
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.count() == 0
    assert stages.pack(spark, d, SF).count() == 0
    some = docs([(1, LONG), (None, None)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(some, none).count() == 0
    assert decontam.contaminated(d, none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages).count() == 0


def test_odd_rows_and_clashing_columns(spark, docs):
    rows = [(None, LONG), (None, None), (1, LONG + " more"), (1, LONG + " more"), (2, ""), (3, "x " * 30000 + "end")]
    d = docs(rows)
    d = d.select("*", *[F.lit(7).alias(c) for c in EXTRA if c not in d.columns])
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    kept = stages.near_dedup(spark, d, SF)
    assert kept.columns == d.columns
    # one of the two texts alike (that of the least id), one of those without words, and the long one
    assert [r[0] for r in key(kept)] in ([1, 2, 3], [1, 3, None]) and len(key(kept)) == 3
    clean = stages.decontamination(spark, d, SF)
    assert clean.columns == d.columns and key(clean) == sorted(rows, key=repr)
    lines = stages.line_dedup(spark, d, SF)
    assert lines.columns == d.columns and {r.text for r in lines.collect()} >= {None, ""}
    packed = stages.pack(spark, d, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3}
