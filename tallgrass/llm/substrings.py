"""Exact substring de-duplication by relative Lempel-Ziv parsing against all documents.

The reference is every document's words, indexed in blocks by content: each window of ``span`` words is named by the
least hash among its ``gram``-word sequences (its anchor), so equal windows anywhere have the same anchor. A document is
parsed only against blocks whose anchor another place shares. For those windows the index gives the first place,
(document, position), that holds the window's words; a window that starts earlier (smaller doc_id, or earlier in the same
document) is a reference. The parse goes from window to window as long as references are found; what it passes is laid
out in tiles of ``span`` words (the last one moved back to end with it), each with the place that it is first found at,
and tiles that follow one another there too are one factor: a copy of consecutive words of one earlier place. Windows
across the boundaries of factors have been looked up on the way, so no word between two references is left in. Words in
factors (each at least ``span`` words long) are duplicate spans.

Moves: anchors (about 2 / (span - gram + 2) of the words), the windows with a shared anchor, one number for each distinct one of
them, each text once (both joins with the texts read one shuffle), and one row for each tile. Counting and minima are
pre-aggregated, so a passage found in a third of all documents lands nowhere as a group. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import as_bytes, dropped, rolled, slices, word_hashes, written

SPAN, GRAM = 20, 5
LAST = (1 << 63) - 1  # stands for a null doc_id


def block_anchors(h: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of span words, and the hashes of all gram-word sequences."""
    g = rolled(h, gram)
    n, low, done = span - gram + 1, g, 1
    if len(g) < n:
        return np.zeros(0, np.uint64), g
    while done < n:  # minima over 2, 4, 8, ... sequences
        step = min(done, n - done)
        low, done = np.minimum(low[:-step], low[step:]), done + step
    return low, g


def parsed_runs(found: np.ndarray, span: int = SPAN) -> list[tuple[int, int]]:
    """(start, end in words) of what the parse passes from window to window, each with a reference; overlapping runs are kept apart."""
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    return [(a, b + span - 1) for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())]


def tiles(runs: list[tuple[int, int]], span: int = SPAN) -> list[int]:
    """Starts of windows that together hold just the words of the runs."""
    out = []
    for a, b in runs:
        out += range(a, b - span + 1, span)
        if (b - a) % span:
            out.append(b - span)
    return out


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


FACTOR = "struct<start: long, end: long, source: long, at: long>"


def _factors(t: Column, span: int) -> Column:
    """Tiles (i, source, at) in order of i, put together where both they and their places follow one another."""
    n = F.size(t)

    def follows(x: Column, y: Column) -> Column:
        return (y["i"] <= x["i"] + span) & (y["source"] == x["source"]) & (y["at"] - x["at"] == y["i"] - x["i"])

    first = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | ~follows(F.get(t, F.greatest(j - 1, F.lit(0))), F.get(t, j)))

    def factor(x: Column) -> Column:
        a, z = F.get(t, x["from"]), F.get(t, x["to"])
        return F.struct(a["i"].cast("long").alias("start"), (z["i"] + span).cast("long").alias("end"), F.nullif(a["source"], F.lit(LAST)).alias("source"), a["at"].cast("long").alias("at"))

    ends = F.concat(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda j: j - 1), F.array(n - 1))
    return F.transform(F.zip_with(first, ends, lambda f, e: F.struct(f.alias("from"), e.alias("to"))), factor)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """An array<long> column as arrays of unsigned hashes."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(size)[:-1]) if len(size) else []


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def remove_duplicates(docs: DataFrame, span: int = SPAN, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """documents -> doc_id, n_words, n_removed, kept_sha256, spans, and kept (text) if asked for.

    spans: the factors as (start, end, source, at): words start to end are those of document source from word at on.

    A null or empty text has no words. Rows with equal doc_ids are one document that several rows describe (repeated
    rows give equal results and do not delete each other); rows without a doc_id come last, as one document. An empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), "text")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, sha, anchors = [], [], []
            for t in as_bytes(b.column(1)):
                w = (t or b"").split()
                low, g = block_anchors(word_hashes(w), span, gram)
                own = np.unique(low)
                if len(own):  # an anchor whose words recur in the text counts twice: it is shared within
                    s = np.sort(g)
                    twice = np.unique(s[1:][s[1:] == s[:-1]])
                    own = np.concatenate([own, np.intersect1d(own, twice, assume_unique=True)])
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).digest())
                anchors.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), _long_lists(anchors)], ["k", "n_words", "sha", "anchors"])

    parsed = written(docs.mapInArrow(parse, "k long, n_words long, sha binary, anchors array<long>"), "parsed")
    base = parsed.select("k", "n_words", "sha")
    # later copies of a whole text need no parse: all their windows are found in the first
    first = base.groupBy("sha").agg(F.min("k").alias("first"))
    whole = base.join(first, "sha").select("k", "n_words", "sha", "first", ((F.col("first") < F.col("k")) & (F.col("n_words") >= span)).alias("copy"))
    whole = written(whole, "copies")
    done = whole.groupBy("k").agg(F.bool_and("copy").alias("copy")).filter("copy").select("k")
    exploded = parsed.select("k", F.explode("anchors").alias("anchor"))
    shared = exploded.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    at = exploded.join(shared, "anchor").groupBy("k").agg(F.collect_set("anchor").alias("anchors"))
    hits = written(at.join(done, "k", "left_anti"), "hits")
    dropped(parsed)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, found, places = b.column(0).to_numpy(zero_copy_only=False), [], []
            for t, own in zip(as_bytes(b.column(1)), _lists(b.column(2))):
                h = word_hashes((t or b"").split())
                low, _ = block_anchors(h, span, gram)
                at = np.nonzero(np.isin(low, own))[0]
                new, first_at = np.unique(rolled(h, span)[at], return_index=True)
                found.append(new)
                places.append(at[first_at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, [len(x) for x in found])), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places))], ["k", "window", "at"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("window", pa.int64())]))
        for b in slices(batches):
            rows = []
            for t, own, mine in zip(as_bytes(b.column(1)), _lists(b.column(2)), _lists(b.column(3))):
                w = (t or b"").split()
                h = word_hashes(w)
                low, _ = block_anchors(h, span, gram)
                win = rolled(h, span)
                refer = np.isin(low, own)
                at = np.nonzero(refer)[0]
                _, first = np.unique(win[at], return_index=True)
                at = at[first]
                refer[at[np.isin(win[at], mine)]] = False  # the place where these words are found first
                runs = parsed_runs(refer, span)
                gone = covered(runs, len(w))
                kept = b" ".join(x for x, g in zip(w, gone.tolist()) if not g) if runs else b" ".join(w)
                asked = tiles(runs, span)
                rows.append((hashlib.sha256(b" ".join(w)).digest(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"i": i, "window": x} for i, x in zip(asked, win[asked].view(np.int64).tolist())], kept.decode() if texts else None))
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], kind), pa.array(c[4], pa.string())], ["k", "sha", "n_removed", "kept_sha256", "tiles", "kept"])

    candidates = docs.join(hits, "k")
    pairs = candidates.select("k", "text", "anchors").mapInArrow(windows, "k long, window long, at int")
    # the first place of each window
    index = written(pairs.groupBy("window").agg(F.min("k").alias("k"), F.min_by("at", "k").alias("at")), "index")
    held = index.groupBy("k").agg(F.collect_list("window").alias("mine"))
    cut = candidates.join(held, "k", "left").select("k", "text", "anchors", "mine").mapInArrow(remove, "k long, sha binary, n_removed long, kept_sha256 string, tiles array<struct<i: int, window: long>>, kept string")
    cut = written(cut.dropDuplicates(["k", "sha"]), "cut")
    asked = cut.select("k", "sha", F.explode("tiles").alias("t")).select("k", "sha", "t.i", "t.window")
    placed = asked.join(index.select("window", F.col("k").alias("source"), "at"), "window").groupBy("k", "sha").agg(F.sort_array(F.collect_list(F.struct("i", "source", "at"))).alias("t"))
    cut = cut.drop("tiles").join(placed.select("k", "sha", _factors(F.col("t"), span).alias("spans")), ["k", "sha"], "left")
    none = F.expr(f"cast(array() as array<{FACTOR}>)")
    zero = F.lit(0).cast("long")
    all_ = F.array(F.struct(zero.alias("start"), F.col("n_words").alias("end"), F.nullif("first", F.lit(LAST)).alias("source"), zero.alias("at")))
    out = whole.join(cut, ["k", "sha"], "left").select(
        F.nullif("k", F.lit(LAST)).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(F.col("copy"), all_).otherwise(F.coalesce("spans", none)).alias("spans"),
        *([F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    return out
