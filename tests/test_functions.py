import numpy as np
from pyspark.sql import functions as F

from tallgrass.functions import scores as S
from tallgrass.functions import text as T
from tallgrass.operators import bundle, cohesion, coverage, graph, lsh, rules, stats
from tallgrass.sources import files, parsers


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_names(spark):
    assert one(spark, T.name_tokens(F.col("s")), s="readBlockSize") == ["read", "block", "size"]
    assert one(spark, T.name_tokens(F.col("s")), s="XMLFeedWriter") == ["xml", "feed", "writer"]
    assert one(spark, T.name_tokens(F.col("s")), s="tide_table-v2.x") == ["tide", "table", "v2"]
    assert one(spark, T.literal_kind(F.col("s")), s="3.14") == "FLOAT_LIT"
    assert one(spark, T.code_of(F.col("s")), s="--") == "GENERIC"
    assert one(spark, T.normalized(F.col("s")), s=" A  b\n# c\n\n// d\nE") == "a b e"
    assert one(spark, T.shingles(F.split(F.col("s"), " "), 3), s="a b") == []


def test_ladders(spark):
    got = [one(spark, S.priority(F.col("v")), v=v) for v in (2.5, 1.7, 1.2, 0.8, 0.3, -2.0)]
    assert got == ["Critical", "High", "Medium", "Low", "None", "Critical"]
    assert abs(one(spark, 0.5 * (1 + S.erf(F.col("v") / 2**0.5)), v=1.645) - 0.95) < 0.01
    assert abs(one(spark, S.lognormal_health(F.col("v"), 800.0, 6000.0), v=6000.0) - 0.05) < 0.01


def test_slots_and_vectors(spark):
    x = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 9], [1.0, 0.0], [0.0, 1.0])], "a array<int>, b array<int>, u array<double>, v array<double>")
    r = x.select(lsh.slot_similarity(F.col("a"), F.col("b")).alias("s"), cohesion.cosine(F.col("u"), F.col("v")).alias("c"), cohesion.cosine(F.col("u"), F.col("u")).alias("d")).first()
    assert (r.s, r.c, r.d) == (0.5, 0.0, 1.0)
    v = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (2, 1, [0.0, 1.0, 0.0]), (3, 1, [0.0, 0.0, 1.0]), (4, 2, [2.0, 0.0, 0.0])], "id long, grp int, v array<double>")
    got = {r.grp: r.cohesion for r in cohesion.cohesion(v).collect()}
    assert 0.5 < got[1] < 0.6 and got[2] == 1.0


def test_spans(spark):
    lines = spark.createDataFrame([("a", n, 0, c) for n, c in ((1, False), (2, False), (3, False), (4, True), (5, False), (6, False), (9, False), (10, False), (11, False))], "path string, line long, hits long, covered boolean")
    spans = coverage.spans(lines)
    assert sorted((r.start, r.stop) for r in spans.collect()) == [(1, 3), (9, 11)]
    near = spark.createDataFrame([("a", 1, 3), ("a", 5, 9), ("a", 20, 22)], "path string, start long, stop long")
    assert sorted((r.start, r.stop) for r in coverage.merged(near).collect()) == [(1, 9), (20, 22)]


def test_parsers(spark):
    r = parsers.lcov(spark.createDataFrame([("SF:lib/tide.go\nDA:7,12\nDA:9,0\nDA:11,3\nend_of_record\nSF:lib/moon.go\nDA:1,0\nend_of_record\n",)], "content string"))
    assert sorted((x.path, x.line, x.hits, x.covered) for x in r.collect()) == [("lib/moon.go", 1, 0, False), ("lib/tide.go", 7, 12, True), ("lib/tide.go", 9, 0, False), ("lib/tide.go", 11, 3, True)]
    r = parsers.istanbul(spark.createDataFrame([('{"web/sail.ts":{"path":"web/sail.ts","l":{"14":5,"20":0,"21":1}}}',)], "content string"))
    assert sorted((x.line, x.covered) for x in r.collect()) == [(14, True), (20, False), (21, True)]


def test_files_and_budgets(spark):
    f = spark.createDataFrame([("a/x.py", 5), ("node_modules/y.py", 5), ("b/z.py", 500), ("noext", 1)], "path string, size long")
    assert [r.path for r in files.selected(f, ["py"], 100, exclude=["node_modules/**"]).collect()] == ["a/x.py"]
    i = spark.createDataFrame([("g", 1, 9.0, 60), ("g", 2, 8.0, 50), ("g", 3, 7.0, 40), ("g", 4, 6.0, 1000)], "key string, id long, priority double, tokens long")
    assert bundle.greedy(i, "key", "id", 100).first().ids == "1,3"


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src long, dst long")
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "src long, dst long")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert [r.node for r in graph.cycle_members(spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string")).collect()] == ["a"]


def test_strong_components(spark):
    """Two rings joined one way, a tail, a loop and a pair, against reachability worked out in Python."""
    edges = [(k, (k + 1) % 12) for k in range(12)] + [(5, 20)] + [(20 + k, 20 + (k + 1) % 5) for k in range(5)] + [(24, 30), (30, 31), (40, 40), (50, 51), (51, 50), (3, 9)]
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            new = {d for s, d in edges if s == x} - seen
            seen |= new
            todo += new
        reach[a] = seen
    want = {a: (min([a] + [b for b in reach[a] if a in reach[b]]), a in reach[a]) for a in reach}
    got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: (r.component, r.cyclic) for r in got} == want and len(got) == len(want)


def test_quantiles_and_ranges(spark):
    rows = [(f, float((k * 37) % 11)) for f, n in (("a", 50), ("b", 7), ("c", 1)) for k in range(n)]
    got = {r.feature: (r.lo, r.mid) for r in stats.quantiles(spark.createDataFrame(rows, "feature string, value double"), {"lo": 0.1, "mid": 0.5}).collect()}
    for f in "abc":
        v = [x for g, x in rows if g == f]
        assert np.allclose(got[f], (np.quantile(v, 0.1), np.quantile(v, 0.5)))
    a = spark.createDataFrame([(k, "f", k * 7 % 100, k * 7 % 100 + k % 90) for k in range(60)], "id long, file string, s long, e long")
    pairs = {(r.a, r.b) for r in rules.overlaps(a, width=8).collect()}
    own = [(r.id, r.s, r.e) for r in a.collect()]
    assert pairs == {(x[0], y[0]) for x in own for y in own if x[0] < y[0] and x[1] <= y[2] and y[1] <= x[2]}


def test_greedy_budget_is_the_fold(spark):
    rows = [("g", k, float((k * 13) % 17), (k * 29) % 40 + 1) for k in range(40)]
    used, ids = 0, []
    for _, k, _, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        if used + n <= 100:
            used, ids = used + n, ids + [str(k)]
    got = bundle.greedy(spark.createDataFrame(rows, "key string, id long, priority double, tokens long"), "key", "id", 100).first()
    assert (got.used, got.ids) == (used, ",".join(ids))
