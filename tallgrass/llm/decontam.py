"""Benchmark decontamination by SimHash windows and a multi-index, in DataFrame functions only.

Texts and items are lower-cased and split into words; shingles are five words (all words of an item that has fewer).
A window is as many words as an item has, or the whole of a document with fewer. Windows that share no shingle with an
item cannot be similar, so only the places around shared shingles are windowed. Each window's SimHash (64 bits over its shingles) is looked up in an index
of the items' fingerprints: these are cut into eight bytes, and each byte is entered with all bytes at most two bits
away, so that every item within 23 bits (8 x 2 + 7) of a window shares an entry with it. Pairs within the radius are
then verified by the weighted Jaccard similarity of their shingle multisets; a shingle weighs as many code points as
its words have. A document holds an item if a window has the similarity asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import words_of, written

SHINGLE, SIMILAR = 5, 0.8
BLOCKS, BLOCK_BITS = 8, 2
BLOCK = 64  # places of shingles that are windowed together
RADIUS = BLOCKS * BLOCK_BITS + BLOCKS - 1
#: Benchmark shingles are broadcast up to this many (8 bytes and two numbers each), and shuffled beyond.
MOST_BROADCAST = 200_000
#: Bits k, k+16, k+32 and k+48 of a hash are counted in one number, up to this many shingles; beyond, bits k and k+32.
MOST_NARROW = 65535


def _shingled(df: DataFrame, key: str, k: int) -> DataFrame:
    """key, h: shingle hashes in order, w: their weights; null in rows with fewer than k words."""
    words = df.select(key, words_of(F.lower("text")).alias("words"))
    hashed = words.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("x"), F.transform("words", lambda w: F.length(w)).alias("l"))
    at = F.when(F.size("x") >= k, F.sequence(F.lit(0), F.size("x") - k))
    h = F.transform(at, lambda i: F.xxhash64(*[F.get("x", i + j) for j in range(k)]))
    w = F.transform(at, lambda i: reduce(lambda a, b: a + b, [F.get("l", i + j) for j in range(k)]))
    return hashed.select(key, h.alias("h"), w.alias("w"))


def simhash(h: Column, wide: bool = False) -> Column:
    """64 bits, each 1 if set in over half of the hashes: of MOST_NARROW hashes at most, or if wide of any number."""
    lane = 32 if wide else 16
    mask = sum(1 << k for k in range(0, 64, lane))
    right = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    zero = F.lit(0).cast("long")
    lanes = F.transform(F.sequence(F.lit(0), F.lit(lane - 1)), lambda k: F.aggregate(h, zero, lambda s, x: s + right(x, k).bitwiseAND(F.lit(mask))))
    ones = lambda s, i: right(F.get(s, i % lane), (F.floor(i / lane) * lane).cast("int")).bitwiseAND(F.lit((1 << lane) - 1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    fold = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda b, i: b.bitwiseOR(F.when(2 * ones(s, i) > F.size(h), bit(i)).otherwise(zero)))
    return F.get(F.transform(F.array(lanes), fold), 0)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def index(items: DataFrame) -> DataFrame:
    """(item_id, m, fp) -> one row for each byte of a fingerprint and each byte at most BLOCK_BITS away."""
    near = [b for b in range(256) if b.bit_count() <= BLOCK_BITS]
    flips = F.array(*map(F.lit, near))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), _byte(F.col("fp"), i).alias("byte")) for i in range(BLOCKS)])
    return items.select("*", F.explode(blocks).alias("b")).select("*", F.explode(flips).alias("flip")).select("item_id", "m", F.col("fp").alias("item_fp"), F.col("b.block").alias("block"), F.col("b.byte").bitwiseXOR(F.col("flip")).alias("byte"))


def _counted(h: Column, w: Column) -> Column:
    """The distinct shingles with their counts and weights."""
    zipped = F.arrays_zip(h.alias("h"), w.alias("w"))
    return F.transform(F.array_distinct(zipped), lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"), F.size(F.filter(h, lambda y: y == x["h"])).alias("n")))


def similarity(item: Column, item_weight: Column, h: Column, weight: Column) -> Column:
    """Weighted Jaccard of an item's counted shingles and a window's hashes."""
    both = F.aggregate(item, F.lit(0).cast("long"), lambda s, x: s + x["w"] * F.least(x["n"], F.size(F.filter(h, lambda y: y == x["h"]))))
    return both / (item_weight + weight - both)


def _total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + x)


def _of_size(docs: DataFrame, bench: DataFrame, k: int, exactly: bool, similar: float) -> DataFrame:
    """Findings for the items whose shingles have k words: items of k words exactly, or of k and more."""
    n = F.size(words_of(F.lower("text")))
    mine = bench.select("item_id", "text", n.alias("m")).filter(F.col("m") == k if exactly else F.col("m") >= k)
    items = _shingled(mine.withColumn("id", F.struct("item_id", "m")), "id", k)
    wide = (mine.agg(F.max("m")).first()[0] or 0) > MOST_NARROW
    items = items.select("id.item_id", "id.m", "h", "w", simhash(F.col("h"), wide).alias("fp"), _counted(F.col("h"), F.col("w")).alias("counted"), _total(F.col("w")).alias("item_weight"))
    items = written(items, "items")
    grams = items.select("m", F.explode("h").alias("gram")).distinct()
    shingled = _shingled(docs.select("doc_id", "text", F.xxhash64("text").alias("row")).withColumn("id", F.struct("doc_id", "row")), "id", k)
    shingled = shingled.select("id.doc_id", "id.row", F.size("h").alias("size"), "h", "w")
    # windows of m words that hold the shingle at pos start from a to b; a document of fewer words is one window, from 0
    first = F.greatest(F.lit(0), F.col("pos") - (F.col("m") - k))
    last = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - (F.col("m") - k) - 1))
    reach = [F.floor(F.col("pos") / BLOCK).cast("int").alias("block"), "m", first.alias("a"), last.alias("b")]
    # for each size of items that a block meets: its shingles, and as many around it as such a window has beyond its first
    begin = F.greatest(F.lit(0), F.col("block") * BLOCK - (F.col("m") - k))
    around = [F.slice(c, begin + 1, BLOCK + 2 * (F.col("m") - k)).alias(c) for c in ("h", "w")]
    # explode_outer, as the filter that Spark infers for explode repeats the whole expression below it
    if grams.count() <= MOST_BROADCAST:
        # the arrays ride along by reference up to the join; of a block's hits one keeps the shingles around it
        at = shingled.select("doc_id", "row", "size", "h", "w", F.posexplode_outer("h").alias("pos", "gram"))
        hits = at.join(F.broadcast(grams), "gram").select("doc_id", "row", *reach, "h", "w").filter("a <= b")
        blocks = hits.select("doc_id", "row", "block", "m", begin.alias("begin"), *around, F.struct("a", "b").alias("r"))
        blocks = blocks.groupBy("doc_id", "row", "block", "m", "begin").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.collect_set("r").alias("reach"))
    else:
        sized = shingled.select("doc_id", "row", "size", "h")
        at = sized.select("doc_id", "row", "size", F.posexplode_outer("h").alias("pos", "gram"))
        hits = at.join(grams, "gram").select("doc_id", "row", *reach).filter("a <= b")
        per = hits.groupBy("doc_id", "row", "block", "m").agg(F.collect_set(F.struct("a", "b")).alias("reach"))
        texts = shingled.select("doc_id", "row", "h", "w").dropDuplicates(["doc_id", "row"])
        blocks = per.join(texts, ["doc_id", "row"]).select("doc_id", "row", "m", begin.alias("begin"), *around, "reach")
    # each start once: windows near one another overlap
    starts = lambda r: F.transform(F.sequence(r["a"], r["b"]), lambda s: F.struct(s.alias("start")))
    placed = blocks.select("doc_id", "m", "begin", "h", "w", F.array_distinct(F.flatten(F.transform("reach", starts))).alias("places"))
    part = lambda a, p: F.slice(a, p["start"] - F.col("begin") + 1, F.col("m") - (k - 1))
    window = lambda p: F.struct(F.col("m").alias("m"), p["start"].alias("start"), part("h", p).alias("h"), _total(part("w", p)).alias("weight"))
    cut = written(placed, "places").select("doc_id", F.explode_outer(F.transform("places", window)).alias("c")).select("doc_id", "c.*")
    windows = cut.select("*", simhash(F.col("h"), wide).alias("fp"))
    probes = windows.select("*", F.explode_outer(F.array(*[F.struct(F.lit(i).alias("block"), _byte(F.col("fp"), i).alias("byte")) for i in range(BLOCKS)])).alias("e")).select("doc_id", "m", "start", "h", "weight", "fp", "e.block", "e.byte")
    entries = index(items.select("item_id", "m", "fp"))
    near = probes.join(entries, ["m", "block", "byte"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("doc_id", "start", "item_id", "h", "weight").dropDuplicates(["doc_id", "start", "item_id", "h"])
    judged = near.join(items.select("item_id", "counted", "item_weight"), "item_id").withColumn("similarity", similarity(F.col("counted"), F.col("item_weight"), F.col("h"), F.col("weight")))
    return judged.filter(F.col("similarity") >= similar).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).cast("long").alias("word"), F.count("*").alias("n_windows"))


def contaminated(docs: DataFrame, bench: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(documents, benchmark) -> doc_id, item_id, similarity, word (where the best window starts), n_windows.

    Null and empty texts hold no item, and an item without a word is in no document. Items of fewer words than a
    shingle have one shingle, all their words. Rows with equal ids are searched each and reported together; of equal
    windows the first is reported; empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    sizes = bench.select(F.size(words_of(F.lower("text"))).alias("m")).filter(F.col("m").between(1, shingle - 1)).distinct().collect()  # fewer than shingle rows
    parts = [_of_size(docs, bench, shingle, False, similar)] + [_of_size(docs, bench, r.m, True, similar) for r in sizes]
    return reduce(DataFrame.unionByName, parts)
