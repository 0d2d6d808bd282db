import random

import numpy as np
import xxhash

from tallgrass.llm import simhash
from tallgrass.llm.components import components


def slow_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow(rows):
    fp = {i: slow_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return {i: (f"{fp[i]:016x}", up(i)) for i in fp}


def test_against_brute_force(spark, docs, sf):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(3)
    for k in range(40):  # near copies of one document
        w = base[5][1].split(" ")
        w[rng.randrange(len(w))] = f"w{k % 9}"
        base.append((1000 + k, " ".join(w)))
    base += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "É é"), (2006, "a b c"), (2007, "word " * 30000)]
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs(base), tile=64).collect()}
    assert got == slow(base)


def test_empty_and_repeated(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    got = simhash.near_duplicates(docs([(3, "a b c d"), (3, "a b c d"), (1, "a b c d")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (3, 1), (3, 1)]


def test_tiles_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x ^ np.uint64(5), x ^ np.uint64(1 << 40)]))
    x = x[np.argsort(np.bitwise_count(x), kind="stable")]
    u, v = simhash.tile_links(x, x, True, 3, sub=16, most=50)
    want = np.arange(len(x))
    p, q = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    want = simhash.forest(p, q, len(x))
    got = np.arange(len(x))
    at = {int(k): i for i, k in enumerate(x)}
    got = simhash.forest(np.array([at[int(k)] for k in u]), np.array([at[int(k)] for k in v]), len(x))
    assert (got == want).all()


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 101), (101, 102), (7, 7), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def slow_groups(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = sorted((up(i), up(j)))
                root[y] = x
    return {frozenset((rows[j][0], rows[j][1]) for j in range(len(rows)) if up(j) == i) for i in range(len(rows)) if up(i) == i}


def edited(seed):
    """Texts with 1 to 12 changed words of one of 200 (similarity about 0.95 to 0.55), and others."""
    rng, rows = random.Random(seed), []
    for g in range(3):
        base = [f"b{g}x{k}" for k in range(200)]
        for k in range(25):
            w = list(base)
            for _ in range(1 + k // 2):
                w[rng.randrange(200)] = f"n{rng.random()}"
            rows.append((g * 100 + k, " ".join(w)))
    return rows + [(500 + k, " ".join(f"o{k}x{rng.random()}" for _ in range(150))) for k in range(60)]


def test_similar_groups_against_brute_force(spark, docs, sf):
    rows = edited(4) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(2000, None), (2001, ""), (2002, "one two")]
    for most in (16, 1):
        got = {}
        for r, t in ((r, dict(rows)[r.doc_id]) for r in simhash.similar_groups(docs(rows), tile=64, most=most).collect()):
            got.setdefault(r.component, set()).add((r.doc_id, t))
        assert {frozenset(g) for g in got.values()} == slow_groups(rows)


def test_near_dedup_stage_catches_similarity(spark, docs, sf):
    import corpus_pipeline as c

    rows = edited(5)
    left = {r.doc_id for r in c.near_dedup(spark, docs(rows), sf).collect()}
    assert left == {min(g)[0] for g in slow_groups(rows)}
