"""The manifest against a plain tree, with groups over many partitions, and on odd rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tallgrass.llm import manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(nodes, fan):
    """The root, and each node's siblings from level to level."""
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), fan):
            run = nodes[at : at + fan]
            for k in range(len(run)):
                for i in held[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            above.append([i for x in held[at : at + fan] for i in x])
        nodes, held = up, above
    return nodes[0] if nodes else None, paths


def whole(rows, fan):
    """(source, doc_id, leaf): (subroot, root, proof), as a list in order."""
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    groups = {}
    for source, doc_id, x in sorted(rows, key=lambda r: (none_first(r[0]), none_first(r[1]), r[2])):
        groups.setdefault(source, []).append((doc_id, x))
    subs = {g: plain([x for _, x in members], fan) for g, members in groups.items()}
    root, tops = plain([s for s, _ in subs.values()], fan)
    out = []
    for (g, members), top in zip(groups.items(), tops):
        for (doc_id, x), p in zip(members, subs[g][1]):
            out.append((g, doc_id, x, subs[g][0], root, p + top))
    return out


def test_against_a_plain_tree(spark):
    rng = random.Random(3)
    for sizes, fan, per in [({"big": 300, "é": 1, None: 17, "a": 3, "z": 64, "Z": 2}, 3, 11), ({"one": 200}, 16, 9), ({f"s{k}": 1 for k in range(40)}, 4, 6), ({"x": 1}, 16, 5), ({"a": 256, "b": 257, "c": 16}, 16, 50)]:
        rows = [(rng.randrange(10**6) if rng.random() > 0.02 else None, f"text {k} Ü", "l" if k % 3 else None, s, k) for s, n in sizes.items() for k in range(n)]
        rows += rows[:5] * 3
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
        got = manifest.manifest(df.withColumn("leaf", F.lit(1)).withColumn("grp", F.lit(2)), fan=fan, rows=per)
        want = whole([(s, i, leaf(i, s, lang, n, t)) for i, t, lang, s, n in rows], fan)
        have = [(r.group, r.key, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in got.collect()]
        assert sorted(have, key=repr) == sorted(want, key=repr)
        assert got.filter(manifest.folded(F.col("other"), F.col("proof")) != F.col("root")).count() == 0


def test_tampering_shows(spark, sf):
    got = {r.doc_id: r for r in queries.op12_merkle_manifest(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        hit = zlib.crc32(str(d.doc_id).encode()) % 5 == 0
        same = not hit or d.text is None or not any("A" <= c <= "Z" for c in d.text)
        assert got[d.doc_id].verified == same and (got[d.doc_id].folded_root == got[d.doc_id].root) == same
        assert got[d.doc_id].leaf == leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)


def test_odd_rows(spark, docs):
    rows = [(None, None), (None, "a"), (1, "A b"), (1, "A b"), (1, ""), (2, "w " * 100000)]
    got = manifest.manifest(docs(rows), rows=2).collect()
    want = whole([("s", i, leaf(i, "s", None, 0 if t is None else len(t), t)) for i, t in rows], 16)
    assert sorted(((r.group, r.key, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in got), key=repr) == sorted(want, key=repr)
    empty = manifest.manifest(docs([]))
    assert empty.count() == 0 and empty.columns == ["group", "key", "leaf", "other", "subroot", "root", "proof"]
    one = manifest.manifest(docs([(5, "x")])).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof == []
