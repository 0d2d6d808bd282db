"""The factors of the parse: each is a copy of consecutive words of an earlier place, and together they are what is removed."""

import random

from tallgrass.llm import substrings


def removed(texts, span):
    """Words covered by a window that also starts earlier, by brute force."""
    seen, gone = {}, {}
    for i in sorted(texts):
        w = texts[i].split()
        for a in range(len(w) - span + 1):
            seen.setdefault(tuple(w[a : a + span]), (i, a))
    for i in sorted(texts):
        w = texts[i].split()
        gone[i] = {j for a in range(len(w) - span + 1) if seen[tuple(w[a : a + span])] < (i, a) for j in range(a, a + span)}
    return gone


def test_factors(spark, docs):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.choice([20, 25, 40, 61, 130]))] for _ in range(12)]
    texts = {}
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            w += [word() for _ in range(rng.randint(0, 30))]
            w += p if rng.random() < 0.6 else p[rng.randint(0, 5) :][: rng.randint(15, 60)]
        texts[i] = " ".join(w)
    texts |= {70: texts[3], 71: texts[3], 72: "a b " * 60, 73: "", 74: " ".join(texts[5].split()[7:]) + " end"}
    got = {r.doc_id: r for r in substrings.remove_duplicates(docs(list(texts.items())), texts=True).collect()}
    gone = removed(texts, 20)
    several = 0
    for i, t in texts.items():
        w, r = t.split(), got[i]
        assert {j for s in r.spans for j in range(s.start, s.end)} == gone[i] and r.n_removed == len(gone[i])
        for s in r.spans:
            assert s.end - s.start >= 20 and (s.source, s.at) < (i, s.start)
            assert w[s.start : s.end] == texts[s.source].split()[s.at : s.at + s.end - s.start]
        for a, b in zip(r.spans, r.spans[1:]):  # factors that follow one another come from different places
            assert b.start > a.end or (b.source, b.at - b.start) != (a.source, a.at - a.start)
        several += len({s.source for s in r.spans}) > 1
    assert several > 5


def test_tiles_hold_the_runs():
    for a, b in ((0, 20), (3, 24), (5, 45), (1, 62)):
        t = substrings.tiles([(a, b)])
        assert {j for i in t for j in range(i, i + 20)} == set(range(a, b))
