"""Counts of k-grams whose texts are shuffled in stretches."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import textstats
from tallgrass.plans import catalog


def texts():
    rng = random.Random(3)
    line = "alpha beta 12 'q' gamma delta of the 3.5 omega"
    made = [" ".join(rng.choice(["alpha", "beta", "gamma", "of", "12", "|", "Long"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [*made, *made[:9], *[f"{line}\n{t}" for t in made[:20]], "of " * 40, "| " * 30, "one two three", "", None, "a b c d e f g h", "a b c d e f g h i"]


def counted(spark, rows, k):
    t = spark.createDataFrame([(x,) for x in rows], "text string")
    kinds = F.transform(textstats.tokens(textstats.normalized(F.col("text"))), textstats.literal_kind)
    every = t.select(kinds.alias("tokens"))
    want = Counter(" ".join(r.tokens[i : i + k]) for r in every.collect() if r.tokens for i in range(len(r.tokens) - k + 1))
    return every, want


@pytest.mark.parametrize("k", [1, 2, 3, 6, 9])
def test_supports_are_those_of_all_windows(spark, k):
    every, want = counted(spark, texts(), k)
    rows = textstats.supports(every, k).collect()
    assert len(rows) == len(want) and {r.gram: r.support for r in rows} == want


def test_only_stretches_are_shuffled(spark, sf):
    kinds = F.transform(textstats.tokens(textstats.normalized(F.col("text"))), textstats.literal_kind)
    every = catalog.entities(spark, sf).select(kinds.alias("tokens"))
    plan = textstats.supports(every, 9)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.split("\n") if " Exchange hashpartitioning" in x] and not any("gram#" in x for x in plan.split("\n") if " Exchange" in x)
    cut = textstats.stretches(every, 9).agg(F.count("*").alias("n"), F.sum(F.size(F.split("stretch", " ")) - 8).alias("windows"), F.sum(F.size(F.split("stretch", " "))).alias("tokens")).first()
    assert cut.windows == every.filter("size(tokens) > 8").agg(F.sum(F.size("tokens") - 8)).first()[0] and cut.tokens < 4 * cut.windows


@pytest.mark.parametrize("percent", [0.5, 100.0])
def test_motifs(spark, percent):
    """Those above the least support that is kept, all of them if that is 1."""
    rows = texts()
    _, want = counted(spark, rows, 9)
    most = max(1, math.ceil(len(want) * percent / 100))
    edge = sorted(want.values(), reverse=True)[most - 1]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id long, text string")
    got = {r.gram: (r.support, round(r.idf, 9)) for r in textstats.stop_motifs(t, 9, percent).collect()}
    assert got == {g: (n, round(math.log(len(rows) / n), 9)) for g, n in want.items() if n >= edge}
    none = spark.createDataFrame([(1, "too short"), (2, None)], "id long, text string")
    assert textstats.stop_motifs(none, 9, percent).collect() == []
