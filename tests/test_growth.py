"""Steps whose tables and tasks do not outgrow their input."""

import re

from tallgrass.operators import dependency, division, graph, textstats
from tallgrass.plans import catalog, catalog4, catalog5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [x for x in plan(df).split("\n") if " Exchange" in x]


def test_masks_are_not_rows(spark, sf):
    df = catalog5.folder_bipartition(spark, sf)
    assert "explode(sequence" not in plan(df) and exchanges(df) and all(re.search(r"hashpartitioning\(l_orderkey#\d+L?, \d+\), REPARTITION_BY_NUM", x) for x in exchanges(df))


def test_bipartition_of_odd_edges(spark):
    nodes = spark.createDataFrame([("d", x, 10) for x in "abcd"] + [("one", "a", 1), ("z", "a", 0), ("z", "b", 0)], "dir string, node string, loc long")
    edges = spark.createDataFrame([("d", "a", "c", 9), ("d", "c", "a", 9), ("d", "b", "d", 5), ("d", "d", "b", 5), ("d", "a", "b", 1), ("d", "a", "gone", 7), ("none", "a", "b", 3), ("d", "a", "a", 50)], "dir string, src string, dst string, weight long")
    got = {(r.dir, r.node): r.part for r in division.bipartitions(nodes, edges).collect()}
    assert got == {("d", "b"): 0, ("d", "d"): 0, ("d", "a"): 1, ("d", "c"): 1, ("z", "a"): 0, ("z", "b"): 1}


def test_settled_folders_leave_the_rounds(spark, monkeypatch):
    made, put = [], division.written

    def counted(df, name):
        t = put(df, name)
        made.append((name, t.count()))
        return t

    monkeypatch.setattr(division, "written", counted)
    nodes = spark.createDataFrame([(d, f"n{i}", 1) for d in "abcd" for i in range(9)], "dir string, node string, loc long")
    edges = spark.createDataFrame([("a", f"n{i}", f"n{i + 1}", 1) for i in range(8)] + [(d, "n0", "n1", 1) for d in "bcd"], "dir string, src string, dst string, weight long")
    found = {(r.dir, r.node): r.label for r in division.labels(nodes, edges).collect()}
    sizes = [n for name, n in made if name == "edges"]
    assert len(found) == 36 and sizes[0] == 11 and len(sizes) > 1 and sizes[-1] < 11
    alone = {(r.dir, r.node): r.label for d in "ab" for r in division.labels(nodes.filter(f"dir = '{d}'"), edges.filter(f"dir = '{d}'")).collect()}
    assert all(found[k] == v for k, v in alone.items())


def test_ids_are_not_broadcast(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)] + [(20, 0), (0, 0)], "src long, dst long")
    assert {(r.node, r.component, r.cyclic) for r in graph.strong_components(edges).collect()} == {(i, 0, True) for i in range(9)} | {(20, 20, False)}
    label = edges.select("src").distinct().selectExpr("src AS node", "src AS label")
    seen, put = [], graph.written
    try:
        graph.written = lambda df, name: seen.append(plan(df)) or put(df, name)
        graph._labels(edges, label)
        graph._shortened(edges)
    finally:
        graph.written = put
    assert seen and not any("BroadcastHashJoin" in p for p in seen)


def test_pairs_and_words_go_to_tasks_that_grow(spark, sf):
    pairs = exchanges(graph.token_pairs(catalog.doc_tokens(spark, sf)))
    assert any(re.search(r"hashpartitioning\(a#\d+L?, b#\d+L?, 32\), REPARTITION_BY_NUM", x) for x in pairs) and any(re.search(r"hashpartitioning\(token#\d+, 16\), REPARTITION_BY_NUM", x) for x in pairs)
    words = exchanges(textstats.select_words(catalog.entities(spark, sf)))
    assert sum("word#" in x for x in words if "hashpartitioning(word#" in x) and not any("hashpartitioning(id#" in x and "word#" in x.split("hashpartitioning")[1].split(")")[0] for x in words)


def test_functions_and_calls_are_not_broadcast(spark, sf, monkeypatch):
    seen, put = [], dependency.written
    monkeypatch.setattr(dependency, "written", lambda df, name: seen.append(plan(df)) or put(df, name))
    seen.append(plan(catalog4.call_edges(spark, sf)))
    assert len(seen) == 3 and not any("Broadcast" in p for p in seen)


def test_files_of_functions_are_not_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(dependency, "call_edges", lambda f, c: spark.range(9).selectExpr("id AS src", "id + 1 AS dst"))
    assert "Broadcast" not in plan(catalog4.module_rollup(spark, sf))


def test_slices_are_not_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(dependency, "call_edges", lambda f, c: spark.range(9).selectExpr("id AS src", "id + 1 AS dst"))
    assert "Broadcast" not in plan(catalog4.slice_crossings(spark, sf))
