"""MinHash signatures, banded candidate search and its summaries.

Entities with equal texts have equal signatures, so the search runs on representatives (the least id of each text) and
membership is a table of its own: groups of copies cost nothing, and no pair of different texts is lost.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.text import hash60, normalized
from tallgrass.session import by_key, written

SLOTS, BANDS = 128, 8


def mask(i: int) -> int:
    """60 bits for the i-th slot, by a rule. The order of hashes after an exclusive-or with it is a permutation of its own."""
    return int(hashlib.md5(f"slot{i}".encode()).hexdigest()[:15], 16)


def exact_groups(entities: DataFrame) -> DataFrame:
    """(id, rep): rep is the least id with the same normalised text."""
    e = entities.select("id", F.md5(normalized(F.col("text"))).alias("fp"))
    rep = e.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    return e.join(rep, "fp").select("id", "rep", "size")


def minima(texts: Column, k: int, n: int) -> Column:
    """For each slot the least masked hash60 of a normalised text's shingles, as array<long>; null if it has none.

    Worked out on arrays, a text at a time: as rows, each shingle would meet n aggregates.
    """

    @F.pandas_udf("array<long>")
    def least(column):
        import numpy as np
        import pandas as pd

        masks = np.array([mask(i) for i in range(n)])
        out = []
        for t in column:
            words = [w for w in t.split(" ") if w] if t else []
            grams = set(zip(*[words[j:] for j in range(k)]))  # repeats do not change a minimum
            sums = np.frombuffer(b"".join([hashlib.md5(" ".join(g).encode()).digest() for g in grams]), ">u8")[::2]
            h = (sums >> np.uint64(4)).astype(np.int64)
            parts = [(h[at : at + 256, None] ^ masks).min(axis=0) for at in range(0, len(h), 256)]
            out.append(np.minimum.reduce(parts) if parts else None)
        return pd.Series(out, dtype=object)

    return least(texts)


def signatures(entities: DataFrame, k: int = 3, n: int = SLOTS) -> DataFrame:
    """(id, sig): for each slot the least masked hash of the text's shingles; texts with none are left out."""
    made = entities.select("id", minima(normalized(F.col("text")), k, n).alias("s"))
    # rows of one id are one entity; minima are combined within a task, so only signatures are shuffled
    whole = made.groupBy("id").agg(*[F.min(F.get("s", F.lit(i))).alias(f"m{i}") for i in range(n)])
    return whole.filter("m0 is not null").select("id", F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def weighted_signatures(bag: DataFrame, n: int = SLOTS) -> DataFrame:
    """(id, sig): least masked hash / weight over (id, gram, weight)."""
    h = bag.select("id", hash60(F.col("gram")).alias("h"), F.greatest("weight", F.lit(1e-8)).alias("w"))
    # rows of 24 bytes are dealt out, as each task's minima for all the texts it meets would be more
    h = by_key(h, "id", each=16)
    minima = h.groupBy("id").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(mask(i))) / F.col("w")).alias(f"m{i}") for i in range(n)])
    return minima.select("id", F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def signature_groups(sigs: DataFrame) -> DataFrame:
    """(id, rep): rep is the least id with an equal signature, so that a group of copies is one member of its buckets."""
    s = sigs.select("id", F.sha2(F.to_json("sig"), 256).alias("fp"))
    return s.join(s.groupBy("fp").agg(F.min("id").alias("rep")), "fp").select("id", "rep")


def slot_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def slot_match(a: Column, b: Column) -> Column:
    """As slot_similarity, but null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), slot_similarity(a, b))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Share of slots less than 1e-6 apart; 0 for empty or unequally long signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (F.abs(x - y) < 1e-6).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def bands(sigs: DataFrame, b: int, rows: int) -> DataFrame:
    """(id, band, bucket)."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.array_join(F.slice("sig", i * rows + 1, rows).cast("array<string>"), ",")).alias("bucket")))
    return sigs.select("id", F.explode(cut).alias("x")).select("id", "x.band", "x.bucket")


def pairs(sigs: DataFrame, b: int = BANDS, rows: int = SLOTS // BANDS, least: float = 0.7) -> DataFrame:
    """(a, b, similarity) of representatives that share a bucket and are similar enough, a < b.

    Of ids with equal signatures the least stands for all (signature_groups gives the others). Signatures are worked out
    once; only buckets with two members and more are joined. There a member has its signature with it, so a pair is judged
    where it is met, and only similar ones are dealt out.
    """
    held = written(sigs, "signatures")
    reps = held.join(signature_groups(held).filter("id = rep").select("id"), "id")
    x = written(bands(reps, b, rows), "bands")
    full = x.groupBy("band", "bucket").agg(F.count("*").alias("c")).filter("c > 1").select("band", "bucket")
    x = x.join(full, ["band", "bucket"]).join(reps, "id")
    x = written(x, "buckets")
    y = x.select("band", "bucket", F.col("id").alias("b"), F.col("sig").alias("sb"))
    met = x.join(y, ["band", "bucket"]).filter("id < b").select(F.col("id").alias("a"), "b", slot_similarity(F.col("sig"), F.col("sb")).alias("similarity"))
    return met.filter(F.col("similarity") >= least).distinct()


def both_ways(p: DataFrame) -> DataFrame:
    return p.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionAll(p.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))


def top_k(p: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return both_ways(p).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def summary(p: DataFrame, high: float = 0.8) -> DataFrame:
    """max, mean and count above high by id, and clone_mass (max if above high, else 0)."""
    s = both_ways(p).groupBy("id").agg(F.max("similarity").alias("max_sim"), F.avg("similarity").alias("mean_sim"), F.count_if(F.col("similarity") > high).alias("n_high"))
    return s.withColumn("clone_mass", F.when(F.col("max_sim") > high, F.col("max_sim")).otherwise(0.0))
