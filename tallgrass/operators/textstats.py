"""Corpus statistics of k-grams and words: document frequency, IDF, weighted bags, selection, stop motifs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallgrass.functions.text import literal_kind, normalized, shingles, tokens
from tallgrass.session import by_key, written


def grams(entities: DataFrame, k: int) -> DataFrame:
    """(id, gram), repeats kept, of the normalised text."""
    return exploded(entities.select("id", tokens(normalized(F.col("text"))).alias("tokens")), k)


def exploded(tokenized: DataFrame, k: int) -> DataFrame:
    """(id, gram) from (id, tokens). explode_outer, as the filter Spark infers for explode would build the array twice."""
    made = tokenized.select("id", shingles(F.col("tokens"), k).alias("grams"))
    return made.select("id", F.explode_outer("grams").alias("gram")).filter("gram is not null")


def document_frequency(entities: DataFrame, k: int) -> DataFrame:
    """Entities that hold each gram. Repeats within a text go before the shuffle, which is the only one."""
    made = entities.select("id", tokens(normalized(F.col("text"))).alias("tokens")).select(F.array_distinct(shingles(F.col("tokens"), k)).alias("grams"))
    return made.select(F.explode_outer("grams").alias("gram")).filter("gram is not null").groupBy("gram").agg(F.count("*").alias("df"))


def _weight(df: Column, total: Column) -> Column:
    return F.ln((1 + total) / (1 + df)) + 1


def idf(entities: DataFrame, k: int) -> DataFrame:
    """ln((1 + N) / (1 + df)) + 1, N being all entities."""
    n = entities.count()
    return document_frequency(entities, k).select("gram", "df", _weight(F.col("df"), F.lit(n)).alias("idf"))


def weighted_bag(entities: DataFrame, k: int) -> DataFrame:
    """tf * idf of each gram of each entity.

    Grams are dealt out once, in tasks that grow with the texts; their counts in a text, their document frequencies and
    the join of both need no other shuffle. Most grams stand in one text alone, so only those of several are looked up.
    """
    n = entities.count()
    tf = by_key(grams(entities, k), "gram", each=16).groupBy("gram", "id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    both = tf.join(df.hint("shuffle_hash"), "gram", "left")
    return both.select("id", "gram", (F.col("tf") * _weight(F.coalesce("df", F.lit(1)), F.lit(n))).alias("weight"))


def top_share(df: DataFrame, share: float = 0.01) -> DataFrame:
    """Unique grams, their summed frequency, and the part (%) held by the most frequent ceil(share).

    The cut is found on counts of frequencies, a table of few rows, so no global sort of the grams is needed; of
    equally frequent grams as many as needed count.
    """
    by = df.groupBy("df").agg(F.count("*").alias("c"))
    total = by.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("df")).alias("total"))
    above = by.select("df", "c", F.sum("c").over(Window.orderBy(F.desc("df"))).alias("upto"))  # a row for each frequency
    most = F.ceil(F.col("n") * share)
    taken = F.greatest(F.lit(0), F.least("c", most - (F.col("upto") - F.col("c"))))
    part = above.crossJoin(F.broadcast(total)).agg(F.max("n").alias("n_grams"), F.max("total").alias("total_df"), (100 * F.sum(taken * F.col("df")) / F.max("total")).alias("top_share"))
    return part


def select_words(entities: DataFrame, share: float = 0.8, low: int = 5, high: int = 40) -> DataFrame:
    """Words of each text by (1 + ln tf) * ln((N + 1) / (df + 1)), until their share or clamp(ceil(3 sqrt(m))) is reached."""
    made = entities.select("id", tokens(normalized(F.col("text"))).alias("tokens"))
    # explode_outer, as the filter that Spark infers for explode would build the array twice; words are dealt out once
    words = by_key(made.select("id", F.explode_outer("tokens").alias("word")).filter("word is not null"), "word", each=16)
    tf = words.groupBy("word", "id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = entities.agg(F.count("*").alias("total"))  # one row
    w = tf.join(df.hint("merge"), "word").crossJoin(F.broadcast(n)).withColumn("weight", F.round((1 + F.ln("tf")) * F.ln((F.col("total") + 1) / (F.col("df") + 1)), 9))
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "word")
    every = Window.partitionBy("id")
    w = w.select(
        "id", "word", "weight",
        F.row_number().over(order).alias("rank"),
        F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(every).alias("all"),
        F.count("*").over(every).alias("m"),
    )
    most = F.least(F.lit(high), F.greatest(F.lit(low), F.ceil(3 * F.sqrt("m"))))
    return w.filter((F.col("all") == 0) | (F.col("rank") <= most) & (F.col("before") < share * F.col("all") - 1e-6)).select("id", "word", "weight", "rank")


def stretches(tokenized: DataFrame, k: int) -> DataFrame:
    """(key, stretch) from (tokens): texts cut up so that each window of k tokens lies in one stretch, and equal windows under one key.

    The key of a window is the least hash of the runs of k // 3 tokens in it; a stretch is the windows beside each other that
    share one, joined by spaces. Runs that end in their first token, such as kinds repeated, are hashed high: few windows have
    no other. A stretch of n windows takes n + k - 1 tokens, so far less is shuffled than n windows of k.
    """
    m = max(1, k // 3)
    # arrays are columns of their own and named twice, as one named once would be worked out again for each window; texts that
    # are too short are not filtered before explode_outer, as the filter would work the arrays out a second time
    size, at = F.size("tokens"), lambda i, j: F.get("tokens", i + j)
    run = lambda i: F.hash(*[at(i, j) for j in range(m)])
    mark = lambda i: F.shiftright(run(i), 2) + F.when(at(i, 0) == at(i, m - 1), 1 << 30).otherwise(0) if m > 1 else run(i)
    x = tokenized.select("tokens", F.when(size >= k, F.transform(F.sequence(F.lit(0), size - m), mark)).alias("marks"))
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]
    low = F.transform(F.sequence(F.lit(0), F.size("marks") - (k - m + 1)), lambda i: least([F.get("marks", i + j) for j in range(k - m + 1)]))
    x = x.select("tokens", F.when(F.col("marks").isNotNull(), low).alias("least"))
    x = x.select("tokens", "least", F.filter(F.sequence(F.lit(0), size - k), lambda i: (i == 0) | (F.get("least", i) != F.get("least", i - 1))).alias("starts"))
    cut = lambda i, j: F.slice("tokens", i + 1, F.coalesce(F.get("starts", j + 1), size - (k - 1)) - i + (k - 1))
    made = F.transform("starts", lambda i, j: F.struct(F.get("least", i).alias("key"), F.array_join(cut(i, j), " ").alias("stretch")))
    return x.select(F.explode_outer(F.when(F.col("least").isNotNull(), made)).alias("s")).select("s.key", "s.stretch").filter("key is not null")


def supports(tokenized: DataFrame, k: int) -> DataFrame:
    """(gram, support) of the k-grams of (tokens), repeats counted; tokens hold no space. Only stretches are shuffled."""
    dealt = by_key(stretches(tokenized, k), "key", each=16)
    size, first = F.size(F.split("stretch", " ")), lambda text, n: F.call_function("substring_index", text, F.lit(" "), n)
    windows = F.transform(F.sequence(F.lit(k), size), lambda i: first(first(F.col("stretch"), i), F.lit(-k)))
    grams = dealt.select("key", F.explode_outer(windows).alias("gram"))
    return grams.groupBy("key", "gram").agg(F.count("*").alias("support")).drop("key")  # a gram has one key


def stop_motifs(entities: DataFrame, k: int = 9, percent: float = 0.5) -> DataFrame:
    """The most frequent ceil(percent) % of k-grams over literal kinds: gram, support, ln(N / support).

    Grams are counted once; those of several places are written, the others only numbered. Should the least support that is
    kept be 1, all are asked for and counted again.
    """
    kinds = F.transform(tokens(normalized(F.col("text"))), literal_kind)
    counts, seen = supports(entities.select(kinds.alias("tokens")), k), Observation()
    several = written(counts.observe(seen, F.count("*").alias("n")).filter("support > 1"), "grams")
    most = max(1, math.ceil(seen.get["n"] * percent / 100))
    # the least support that is kept, from counts of supports
    by = several.groupBy("support").agg(F.count("*").alias("c"))
    upto = by.select("support", F.sum("c").over(Window.orderBy(F.desc("support"))).alias("upto"))
    edge = upto.filter(F.col("upto") >= most).agg(F.max("support")).first()[0]  # one number
    kept = several.filter(F.col("support") >= edge) if edge else counts
    n = entities.agg(F.count("*").alias("total"))  # one row
    return kept.crossJoin(F.broadcast(n)).select("gram", "support", F.ln(F.col("total") / F.col("support")).alias("idf"))
