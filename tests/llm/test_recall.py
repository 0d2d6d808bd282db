"""Windows of all documents against all items by brute force: what the SimHash index of the decontamination finds of them."""

import re
from collections import Counter

from tallgrass.llm import decontam

SF = "/root/testdata/sf0.01"


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]", (text or "").lower()) if w]


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def similar_windows(doc, item, k):
    """Number of the document's windows with a weighted Jaccard similarity of 0.8, each window compared."""
    weight = lambda g: sum(map(len, g))
    want, m = Counter(grams(item, k)), len(item)
    all_ = grams(doc, k)
    if not set(all_) & set(want):
        return 0  # no window shares a shingle, so none is similar
    per, found = m - k + 1, 0
    total = sum(n * weight(g) for g, n in want.items())
    window, held, both = Counter(), 0, 0
    for i, g in enumerate(all_):
        held += weight(g)
        both += weight(g) * (window[g] < want[g])
        window[g] += 1
        if i >= per:
            old = all_[i - per]
            window[old] -= 1
            held -= weight(old)
            both -= weight(old) * (window[old] < want[old])
        if i >= per - 1 or i == len(all_) - 1 < per - 1:
            found += both >= 0.8 * (total + held - both)
    return found


def test_windows_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts, items = {r.doc_id: words(r.text) for r in docs.collect()}, {r.item_id: words(r.text) for r in bench.collect()}
    want = {}
    for i, d in texts.items():
        for j, t in items.items():
            if t and (n := similar_windows(d, t, min(5, len(t)))):
                want[i, j] = n
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) <= set(want)
    pairs, windows = len(set(got) & set(want)) / len(want), sum(min(got.get(p, 0), n) for p, n in want.items()) / sum(want.values())
    print(f"{len(want)} pairs, {sum(want.values())} windows; found {pairs:.4f} of the pairs, {windows:.4f} of the windows")
    assert pairs >= 0.99 and windows >= 0.9
