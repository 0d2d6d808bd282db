"""A kept view: only changed groups are worked out, and readers see whole states."""

from pyspark.sql import functions as F

from tallgrass.operators import kept

KIND = "grp string, path string, mark string, size long"


def test_refresh(spark, tmp_path):
    seen = []

    def work(files):
        seen.append(sorted({r.grp for r in files.select("grp").collect()}))
        return files.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n"))

    view = kept.View(spark, f"file://{tmp_path}/view", work)
    files = [("a", "a/1", "x", 1), ("a", "a/2", "y", 2), ("b", "b/1", "z", 5), ("c", "c/1", "q", 7)]
    df = lambda rows: spark.createDataFrame(rows, KIND)
    got = lambda: {r.grp: (r["size"], r.n) for r in view.rows().collect()}
    assert view.refresh(df(files), now=1000) == 3 and seen[-1] == ["a", "b", "c"]
    assert got() == {"a": (3, 2), "b": (5, 1), "c": (7, 1)}
    # nothing changed, in another order: nothing is read
    assert view.refresh(df(files[::-1]), now=2000) == 0 and len(seen) == 1 and view.version() == 1
    # one file changed, one group new, one gone: only the two are worked out
    before = view.rows()
    files = [("a", "a/1", "x", 1), ("a", "a/2", "new", 9), ("b", "b/1", "z", 5), ("d", "d/1", "k", 4)]
    assert view.refresh(df(files), now=3000) == 2 and seen[-1] == ["a", "d"]
    assert got() == {"a": (10, 2), "b": (5, 1), "d": (4, 1)}
    assert {r.grp for r in before.collect()} == {"a", "b", "c"}  # a reader of the version before goes on
    # a group of seven days ago is old, those of later are not
    assert view.refresh(df(files), now=1000 + kept.MAX_AGE + 1) == 1 and seen[-1] == ["b"]
    # a change that is known to be small is left
    small = [("a", f"a/{k}", "x", 1) for k in range(100)]
    view.refresh(df(small), now=5000)
    small[0] = ("a", "a/0", "y", 1)
    assert view.stale(df(small), 6000, changed=F.lit(0.01)).count() == 0
    assert view.stale(df(small), 6000).count() == 1
    assert view.refresh(df([]), now=7000) == 0 and view.rows().count() == 0


def test_groups_as_one_pass_gives_them(spark, tmp_path):
    """Whatever the steps were, the kept rows are those of one pass over the files of now."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = docs.select(F.col("source").alias("grp"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("mark"), F.col("n_chars").alias("size"))
    view = kept.View(spark, f"file://{tmp_path}/docs", lambda f: f.groupBy("grp").agg(F.sum("size").alias("size")))
    view.refresh(files.filter("grp not like '%3'"), now=1)
    n = view.refresh(files.withColumn("mark", F.when(F.col("grp") == "src1", "other").otherwise(F.col("mark"))), now=2)
    assert 1 <= n < files.select("grp").distinct().count()
    want = {(r.grp, r["size"]) for r in files.groupBy("grp").agg(F.sum("size").alias("size")).collect()}
    assert {(r.grp, r["size"]) for r in view.rows().collect()} == want
