"""Signatures worked out on arrays, and pairs judged in their buckets."""

import hashlib

from tallgrass.operators import lsh


def signature(text, k, n):
    words = text.split()
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return [min(int(hashlib.md5(g.encode()).hexdigest()[:15], 16) ^ lsh.mask(i) for g in grams) for i in range(n)] if grams else None


def test_signatures(spark):
    long = " ".join(f"wörd{i % 700}" for i in range(900))  # more shingles than are hashed at once
    rows = [(1, "a b c a b c"), (2, "A  b\n c\n# x y z\n"), (3, None), (4, ""), (5, "a b"), (6, long), (7, "x y z"), (7, "p q r")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.sig for r in lsh.signatures(df, 3, 8).collect()}
    assert set(got) == {1, 2, 6, 7}
    assert got[1] == signature("a b c a b c", 3, 8) and got[2] == signature("a b c", 3, 8) and got[6] == signature(long, 3, 8)
    assert got[7] == [min(x) for x in zip(signature("x y z", 3, 8), signature("p q r", 3, 8))]
    p = lsh.signatures(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in p and p.count("ArrowEvalPython") == 1  # no row for a shingle; a text is worked on once


def test_pairs_are_judged_in_their_buckets(spark):
    sigs = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [1, 2, 9, 9]), (4, [1, 2, 3, 4]), (5, [7, 7, 7, 7])], "id long, sig array<long>")
    df = lsh.pairs(sigs, b=2, rows=2, least=0.6)
    assert {(r.a, r.b): r.similarity for r in df.collect()} == {(1, 2): 0.75}
    exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert all("hashpartitioning(a#" not in x or "similarity#" in x for x in exchanges)
