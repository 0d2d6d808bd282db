"""Divided folders against plain loops."""

import random
import zlib
from collections import defaultdict

import pytest

from tallgrass.operators import division

NODES, EDGES = "dir string, node string, loc long", "dir string, src string, dst string, weight long"


def graph(rng, sizes, degree=2):
    nodes, edges = [], []
    for d, n in sizes.items():
        names = [f"n{k:03}" for k in range(n)]
        nodes += [(d, x, rng.randint(1, 300)) for x in names]
        for x in names:
            for _ in range(rng.randint(0, degree)):
                edges.append((d, x, rng.choice(names), rng.randint(1, 4)))
    return nodes, edges


def out_of(edges, d):
    w = defaultdict(int)
    for e, a, b, x in edges:
        if e == d and a != b:
            w[a, b] += x
    return w


def test_bipartitions(spark):
    rng = random.Random(4)
    sizes = {f"d{k}": rng.randint(1, 10) for k in range(25)}
    nodes, edges = graph(rng, sizes)
    nodes.append(("skew", "a", 1000))
    nodes += [("skew", "b", 1), ("skew", "c", 1)]
    nodes += [("bare", "x", 0), ("bare", "y", 0)]
    got = defaultdict(dict)
    for r in division.bipartitions(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect():
        got[r.dir][r.node] = r.part
    for d in {x[0] for x in nodes}:
        own = sorted((n, loc) for e, n, loc in nodes if e == d)
        n = len(own)
        if not 2 <= n <= 8:
            assert d not in got
            continue
        w, total, best = out_of(edges, d), sum(x for _, x in own), None
        for mask in range(1, 2**n - 1):
            inside = {own[i][0] for i in range(n) if mask >> i & 1}
            loc = sum(x for name, x in own if name in inside)
            uneven = abs(loc / total - 0.5) if total else 0.0
            cut = sum(x for (a, b), x in w.items() if a in inside and b not in inside)
            if uneven <= 0.25 and (best is None or (cut, uneven, mask) < best):
                best = cut, uneven, mask
        mask = best[2] if best else 2 ** (n // 2) - 1
        assert got[d] == {own[i][0]: 1 - (mask >> i & 1) for i in range(n)}


def voted(names, w, rounds=100):
    label = {x: x for x in names}
    turn = {x: (zlib.crc32(x.encode()), x) for x in names}
    for _ in range(rounds):
        would = {}
        for x in names:
            votes = defaultdict(int)
            for (a, b), v in w.items():
                if a == x:
                    votes[label[b]] += v
            if votes:
                v, to = min((-v, k) for k, v in votes.items())
                if -v > votes.get(label[x], 0):
                    would[x] = to
        if not would:
            break
        waits = {max(a, b, key=turn.get) for a, b in w if a in would and b in would}
        for x, to in would.items():
            if x not in waits:
                label[x] = to
    return label


def test_labels_of_200_nodes(spark):
    rng = random.Random(7)
    nodes, edges = graph(rng, {"a": 200, "b": 30})
    nodes += [("pair", "x", 1), ("pair", "y", 1)]
    edges += [("pair", "x", "y", 1), ("pair", "y", "x", 1)]
    got = defaultdict(dict)
    for r in division.labels(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect():
        got[r.dir][r.node] = r.label
    for d in ("a", "b", "pair"):
        assert got[d] == voted([n for e, n, _ in nodes if e == d], out_of(edges, d))


def plain_refined(part, w, most, passes=10):
    for _ in range(passes):
        moved = False
        for i in range(most + 1):
            for j in range(i + 1, most + 1):
                best = None
                for x, p in part.items():
                    if p in (i, j):
                        gain = sum(v if part[b] != p else -v for (a, b), v in w.items() if a == x and part[b] in (i, j))
                        if gain > 0 and (best is None or (-gain, p, x) < best):
                            best = -gain, p, x
                if best:
                    part[best[2]] = i + j - best[1]
                    moved = True
        if not moved:
            break
    return part


def test_refined(spark):
    rng = random.Random(9)
    nodes, edges = graph(rng, {"a": 60, "b": 12})
    parts = [(d, n, rng.randrange(3 if d == "a" else 2)) for d, n, _ in nodes]
    got = defaultdict(dict)
    for r in division.refined(spark.createDataFrame(parts, "dir string, node string, part int"), spark.createDataFrame(edges, EDGES), passes=3).collect():
        got[r.dir][r.node] = r.part
    for d in ("a", "b"):
        assert got[d] == plain_refined({n: p for e, n, p in parts if e == d}, out_of(edges, d), 2, passes=3)


def test_parts_of_labels(spark):
    found = [("m", f"n{k}", f"l{min(k, 4)}") for k in range(10)] + [("s", f"n{k}", "one") for k in range(9)]
    k = spark.createDataFrame([("m", 10, 0, 2), ("s", 9, 0, 4)], "dir string, n long, loc long, k int")
    got = defaultdict(lambda: defaultdict(set))
    for r in division.to_parts(spark.createDataFrame(found, "dir string, node string, label string"), k).collect():
        got[r.dir][r.part].add(r.node)
    # l0..l3 have one node and l4 six: the small ones are put together
    assert sorted(map(len, got["m"].values())) == [4, 6]
    # 9 nodes: 4 + 5, then 4 + 2 + 3, then 2 + 2 + 2 + 3
    assert sorted(map(len, got["s"].values())) == [2, 2, 2, 3]
    assert sum(map(len, got["s"].values())) == 9


def test_names(spark):
    nodes = [("d", "a/user_store.py", 5), ("d", "a/user-cache.py", 6), ("d", "a/test_x.py", 7), ("d", "b/12_34.py", 8), ("d", "b/file.py", 1), ("d", "b/file_file.py", 1)]
    parts = [("d", n, 0 if n.startswith("a") else 1) for _, n, _ in nodes]
    got = {r.part: (r.name, r.files, r.loc) for r in division.named(spark.createDataFrame(parts, "dir string, node string, part int"), spark.createDataFrame(nodes, NODES)).collect()}
    assert got == {0: ("user", 3, 18), 1: ("io", 3, 10)}


@pytest.mark.parametrize("empty", [True, False])
def test_divided(spark, empty):
    nodes, edges = ([], []) if empty else graph(random.Random(1), {"a": 6, "b": 20, "c": 1})
    n = spark.createDataFrame(nodes, NODES)
    got = division.divided(n, spark.createDataFrame(edges, EDGES))
    assert sorted((r.dir, r.node) for r in got.collect()) == sorted((d, x) for d, x, _ in nodes)


def test_communities_are_the_greedy_ones(spark):
    from tallgrass.operators import layout

    rng = random.Random(11)
    pairs = {}
    for f, n, m in (("a", 40, 90), ("b", 300, 400), ("c", 4, 3)):
        for _ in range(m):
            x, y = sorted(rng.sample(range(n), 2))
            pairs[f, x, y] = rng.choice([0.15, 0.2, 0.3, 0.5, 0.9])
    pairs |= {("chain", k, k + 1): 0.2 + k / 1000 for k in range(200)}
    want = {}
    for f in ("a", "b", "c", "chain"):
        comm, at = [], {}
        for s, x, y in sorted((-s, x, y) for (g, x, y), s in pairs.items() if g == f):
            if -s < 0.2:
                break
            if x in at and y not in at:
                comm[at[x]].append(y)
                at[y] = at[x]
            elif y in at and x not in at:
                comm[at[y]].append(x)
                at[x] = at[y]
            elif x not in at:
                at[x] = at[y] = len(comm)
                comm.append([x, y])
        for k, c in enumerate([c for c in comm if len(c) >= 3][:3]):
            want |= {(f, x): k for x in c}
    df = spark.createDataFrame([(f, x, y, s) for (f, x, y), s in pairs.items()], "file string, id long, other long, similarity double")
    assert {(r.file, r.id): r.community for r in layout.communities(df).collect()} == want


def test_empty_sets_are_equal_and_files_are_split(spark):
    from tallgrass.operators import layout

    e = spark.createDataFrame([("f", 1, []), ("f", 2, []), ("f", 3, ["x"]), ("g", 4, [])], "file string, id long, words array<string>")
    assert [(r.file, r.id, r.other, r.shared, r.similarity) for r in layout.identifier_pairs(e).collect()] == [("f", 1, 2, 0, 1.0)]
    found = spark.createDataFrame([("f", k, k // 3) for k in range(6)] + [("g", 9, 0)], "file string, id long, community int")
    names = ["readX", "api_y", "loader", "helper", "util", "core"]
    ents = spark.createDataFrame([("f", k, names[k], 10 * k) for k in range(6)] + [("g", 9, "a", 1)], "file string, id long, name string, loc long")
    files = spark.createDataFrame([("f", "src/big.ts", 900, 10), ("g", "g", 900, 10)], "file string, path string, loc long, bytes long")
    got = {r.community: (r.name, r.members, r.loc) for r in layout.splits(found, ents, files).collect()}
    assert got == {0: ("big_io.ts", 3, 30), 1: ("big_util.ts", 3, 120)}
