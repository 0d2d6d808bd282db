"""Ignore rules against a plain reading of them, fan-in, and the tree of folders."""

import fnmatch
import re

import pytest

from tallgrass.operators import gaps, health
from tallgrass.sources import files as source

RULES = {"": "# all\n\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/*.tmp\na/**\n!a/b\n**/deep\nx?.c\n", "src": "*.py\n!main.py\n/gen\n", "src/gen2": "!*.py\n*.md\n", "lib": "!x1.log\nsub/*.o"}
PATHS = ["a.log", "keep.log", "src/keep.log", "src/b.log", "build/x", "src/build/y/z", "build2/x", "top.txt", "src/top.txt", "docs/a.tmp", "docs/p/q/r.tmp", "doc/p.tmp", "a/b", "a/c/d", "q/deep", "deep/z", "x1.c", "x12.c", "src/m.py", "src/main.py", "src/u/main.py", "src/gen/f", "src/u/gen/f", "src/gen2/k.py", "src/gen2/n.md", "lib/x1.log", "lib/sub/t.o", "lib/sub/u/t.o", "lib/build", "src/gen3"]


def plain(path):
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        step, folder, last = "/".join(parts[:k]), k < len(parts), None
        for d in range(k):
            base = "/".join(parts[:d])
            rest = "/".join(parts[d:k])
            for line in RULES.get(base, "").split("\n"):
                if not line or line.startswith("#"):
                    continue
                allow, body = line.startswith("!"), line.lstrip("!")
                only, body = body.endswith("/"), body.rstrip("/")
                at = body.lstrip("/")
                if "**" in at:
                    rx = re.escape(at).replace(r"\*\*/", "(.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*")
                    hit = re.fullmatch(rx, rest)
                elif "/" in body:
                    hit = re.fullmatch(fnmatch.translate(at).replace(".*", "[^/]*").replace("(?s:.)", "[^/]"), rest)
                else:
                    hit = fnmatch.fnmatchcase(rest.split("/")[-1], at)
                if hit and (folder or not only):
                    last = allow
        if last is False:
            return False
    return True


def test_ignore_rules(spark):
    rules = source.ignore_rules(spark.createDataFrame(list(RULES.items()), "dir string, text string"))
    got = {r.path for r in source.not_ignored(spark.createDataFrame([(p, 1) for p in PATHS], "path string, size long"), rules).collect()}
    assert got == {p for p in PATHS if plain(p)}
    none = source.ignore_rules(spark.createDataFrame([("", "#x\n\n")], "dir string, text string"))
    assert source.not_ignored(spark.createDataFrame([("a", 1)], "path string, size long"), none).count() == 1


def test_fan_in(spark):
    lines = ["def foo(x):", "  return bar(foo, x)", "y = foo(1)", "bar = foo + foo_2", ""]
    l = spark.createDataFrame([("f", k + 1, x) for k, x in enumerate(lines)] + [("g", 1, "foo foo")], "path string, line long, x string")  # noqa: E741
    s = spark.createDataFrame([("f", 1, 2, "foo"), ("f", 1, 2, "nothing"), ("f", 3, 3, "zzz"), ("f", 3, 3, "yyy")], "path string, start long, stop long, name string")
    assert {(r.path, r.start): r.fan_in for r in gaps.fan_in(s, l).collect()} == {("f", 1): 2, ("f", 3): 2}


def test_folder_tree(spark):
    folders = [("a", None), ("a/b", None), ("a/b/c", 0.5), ("a/d", None), ("a/e", 0.0), ("z", 0.9)]
    files = [("a/b/f", 0.7), ("a/b/g", 0.0), ("a/x", 0.4), ("a/e/y", 0.8)]
    got = {r.path: (r.health, r.computed) for r in health.folder_tree(spark.createDataFrame(folders, "path string, health double"), spark.createDataFrame(files, "path string, health double")).collect()}
    assert got["a/b"] == (pytest.approx(0.6), True) and got["a"] == (pytest.approx(0.5), True)
    assert got["a/d"] == (0.0, True) and got["a/e"] == (0.0, False) and got["z"] == (0.9, False)
    assert health.folder_tree(spark.createDataFrame([], "path string, health double"), spark.createDataFrame([], "path string, health double")).count() == 0
