"""Call edges from few candidates are those that scoring every function of a name gives."""

import random

from tallgrass.operators import dependency


def score(call, f, g, key_rank):
    segs, whole, base, space = call
    parts = [x.lower() for x in g[2]] + [g[1].lower()]
    if f[0] == g[0] and base != g[1].lower():
        return None
    qualified = "::".join(parts)
    s = 120 if f[0] == g[0] else 0
    s += 100 if qualified == whole else 75 if ("::" + whole).endswith("::" + qualified) else 40 if g[1].lower() == base else 0
    low = [x.lower() for x in g[2]]
    s += 50 if space and len(space) <= len(low) and low[-len(space):] == space else 0
    s += 20 if f[3] is not None and f[3] == g[3] else 0
    mine = [x.lower() for x in f[2]]
    s += 15 if mine == low else 8 if mine and low and mine[-1] == low[-1] else 0
    away = 400 if f[4] is None or g[4] is None else min(abs(f[4] - g[4]), 400)  # an unknown line is far away
    return (-key_rank, s + 15 - away // 25, g[3] or "", -1 if g[4] is None else g[4], g[0])


def test_edges_are_those_of_all_candidates(spark):
    rng = random.Random(11)
    spaces = [["A"], ["A", "b"], ["c", "B"], ["b"], ["A::b"]]
    fs = [(k, rng.choice(["f", "g", "H", "x::f"] if k % 9 == 0 else ["f", "g", "H"]), rng.choice(spaces), rng.choice(["p", "q", "r", None]), rng.choice([None, *(rng.randrange(1500) for _ in range(12))])) for k in range(240)]
    calls = [(k, raw) for k in range(240) for raw in rng.sample(["f(x)", "self.B::g(y)", "a::b::f()", "b.h(z)", "nowhere(1)", "c::f()", "z::a::b::g()"], 2)]
    want = set()
    for uid, raw in calls:
        segs = [x for x in raw.split("(")[0].lower().replace(".", "::").split("::") if x]
        segs = segs[1:] if segs[0] == "self" else segs
        call = (segs, "::".join(segs), segs[-1], segs[:-1])
        best = []
        for g in fs:
            parts = [x.lower() for x in g[2]] + [g[1].lower()]
            keys = {"::".join(parts[i:]) for i in range(len(parts))}
            for rank in range(len(segs)):
                if "::".join(segs[rank:]) in keys:
                    got = score(call, fs[uid], g, rank)
                    best += [(got, g[0])] if got else []
        if best:
            want.add((uid, max(best)[1]))
    f = spark.createDataFrame(fs, "uid long, name string, namespace array<string>, file string, line long")
    got = [(r.src, r.dst) for r in dependency.call_edges(f, spark.createDataFrame(calls, "uid long, raw string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
