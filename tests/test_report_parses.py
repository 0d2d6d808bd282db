"""Texts of reports are parsed once for what is read from them."""

import json
import re

from pyspark.sql import functions as F

from tallgrass.plans import catalog5
from tallgrass.sources import reports


def plans(spark, monkeypatch, made):
    """Plans of the tables that are written on the way, and of the result."""
    found, put = [], reports.written
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(reports, "written", lambda df, name: found.append((name, plan(df))) or put(df, name))
    return [*(found if (df := made()) else found), ("result", plan(df))]


def test_texts_are_not_parsed_by_filters(spark, sf, monkeypatch):
    got = dict(plans(spark, monkeypatch, lambda: reports.lines(catalog5.order_reports(spark, sf))))
    assert set(got) == {"reports", "found", "result"} and "Filter" not in got["reports"].replace("PushedFilters", "")
    # the filters that are left only ask whether a text is damaged
    assert "Union" not in got["found"] and not any(re.search(r"size\(|packages|statementMap|_corrupt_record.*line", x) for p in got.values() for x in p.split("\n") if re.match(r"[\s:+|-]*Filter ", x))


def test_objects_at_all_depths(spark):
    at = lambda n: {"path": f"d{n}.js", "l": {str(n): n, "9": 0}}
    escaped = '{"a": {"\\u0070ath": "e.js", "l": {"1": 2}}, "t": "\\u007b\\"file\\": \\"t.js\\", \\"l\\": [null, 3]}"}'
    deep = at(5)
    for _ in range(5):
        deep = {"x": deep}  # five levels down: too deep
    texts = {
        "own.json": json.dumps(at(0) | {"in": [at(1) | {"in": {"y": at(3)}}, [at(2)]], "far": deep}),
        "escaped.json": escaped,
        "map.json": json.dumps({"m": {"url": "m.js", "statementMap": {"0": {"start": {"line": 4}}, "1": {"start": {"line": 6}}}, "s": {"0": 7}}}),
        "none.json": json.dumps({"path": None, "l": {"1": 1}, "k": [1, "{", "path"]}),
        "list.json": "[" + json.dumps(at(1)) + "]",
    }
    t = spark.createDataFrame(list(texts.items()), "report string, content string")
    got = {(r.report, r.file, r.line): (r.hits, r.covered) for r in reports.lines(t).select("report", "file", "line", "hits", "covered").collect()}
    want = {("own.json", f"d{n}.js", k): (h, h > 0) for n in (0, 1, 2, 3) for k, h in ((n, n), (9, 0))}
    want |= {("escaped.json", "e.js", 1): (2, True), ("escaped.json", "t.js", 2): (3, True), ("map.json", "m.js", 4): (7, True), ("map.json", "m.js", 6): (0, False), ("list.json", "d1.js", 1): (1, True), ("list.json", "d1.js", 9): (0, False)}
    assert got == want
