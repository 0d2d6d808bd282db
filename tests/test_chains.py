"""Strong components of graphs with long chains, against a plain search."""

import os
import random

from tallgrass.operators import graph
from tallgrass.session import shared_dir


def plain(edges):
    nodes = {x for e in edges for x in e}
    to = {x: set() for x in nodes}
    for a, b in edges:
        to[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in to[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    r = {x: reach(x) for x in nodes}
    return {x: (min([x, *(y for y in r[x] if x in r[y])]), x in r[x]) for x in nodes}


def found(spark, edges):
    return {r.node: (r.component, r.cyclic) for r in graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_small_graphs(spark):
    rng = random.Random(5)
    cases = [[(k, k + 1) for k in range(40)] + [(39, 7)], [(k, (k + 1) % 30) for k in range(30)] + [(50, 3), (9, 60), (60, 61), (61, 61)]]
    cases.append([(rng.randrange(60), rng.randrange(60)) for _ in range(70)])
    cases.append([(9, 1), (1, 9), (2, 3), (3, 4), (4, 2), (5, 5)])
    edges = [(100 * k + a, 100 * k + b) for k, case in enumerate(cases) for a, b in case]  # one graph of four
    assert found(spark, edges) == plain(edges)


def test_a_path_of_ten_thousand_nodes(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    got = found(spark, [(k, k + 1) for k in range(10_000)])
    assert len(got) == 10_001 and all(v == (k, False) for k, v in got.items())
    assert len(os.listdir(folder)) - before < 40
