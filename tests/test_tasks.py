"""Plans whose shuffles and tasks are those intended."""

import re

from tallgrass.operators import lsh, textstats
from tallgrass.plans import catalog, catalog5
from tallgrass.session import by_key


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_files(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    n = int(re.search(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan(by_key(t, "l_orderkey", each=16)))[1])
    assert n >= 16 and n % 16 == 0
    assert re.search(r"hashpartitioning\(id#\d+L?, 8\)", plan(by_key(spark.range(9), "id")))


def test_scores_shuffle_the_lines_once(spark, sf):
    for name in ("category_scores", "top_contributors", "dominant_category"):
        p = plan(catalog.QUERIES[name](spark, sf))
        assert "SortMergeJoin" not in p and "hashpartitioning(entity_id" not in p and "hashpartitioning(feature" in p


def test_grams_are_dealt_out_once(spark, sf):
    bag = textstats.weighted_bag(catalog.entities(spark, sf), 3)
    assert "hashpartitioning(gram#" in plan(bag) and ", id#" not in "".join(x for x in plan(bag).split("\n") if "Exchange" in x)
    assert "partial_min" not in "".join(x for x in plan(lsh.weighted_signatures(bag)).split("\n") if "Exchange" in x)


def test_import_keys_are_not_broadcast(spark, sf):
    assert "BroadcastHashJoin" not in plan(catalog5.import_resolution(spark, sf))
