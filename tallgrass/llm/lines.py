"""Line de-duplication by an exact set-similarity join.

A line is its set of words. A line is removed if an earlier one (smaller doc_id, or earlier in the same document) has
a Jaccard similarity of ``similar`` or more with it; lines are judged on the input, not on what is left. Lines with
fewer than ``least`` words are left alone.

1. Words are counted into a fixed number of buckets; the counts' logarithms (a byte each) order words by rarity.
2. Lines with equal sets (128 bits) are one set, held by the first of them.
3. Each set is posted under the words of its prefix: two similar sets share one of their rarest words.
4. Under each word, sorted by size, pairs pass the length filter, the positional filter, and a bound from sketches of
   64 bits, or 128 for large sets (each word that only one set has flips one bit). Each set passes on its nearest earlier partner under each of its
   words, not all pairs. Words that hold a noticeable share of all postings are dealt out in cells of block pairs, as many
   as it takes.
5. Pairs are verified on the sets themselves, made again from the texts of the lines concerned.
6. Sets of which no partner passed though there were others are compared with every partner, so nothing is lost.
7. Each line is joined with its set, if that has several lines or an earlier partner. The few sets with a noticeable share
   of all lines are joined by broadcast, so that no task receives them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import SIEVE, as_bytes, mixed, sifted, slices, tokens, written

LAST = (1 << 63) - 1  # stands for a null doc_id
BUCKETS, WIDTH = 1 << 22, 4096  # buckets of words; buckets moved together
HOT = 1024  # postings under one word that are compared in one cell
SHARE = 50_000  # a word or a set with over one in so many of all postings or lines is dealt with apart
TASK = 500_000  # postings of a task
LARGE = 80  # words of a set from which on it has a sketch of 128 bits
SIMILAR = Fraction(4, 5)


def _coded(n: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, a byte each."""
    return np.minimum(255, np.rint(8 * np.log2(n + 1.0))).astype(np.uint8)


def rarity(docs: DataFrame) -> np.ndarray:
    """For each bucket of words the number of their occurrences in all texts, coded (4 MB)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(BUCKETS, np.int64), [], 0
        for b in slices(batches, 4 << 20):
            _, h = tokens(b"\n".join(t for t in as_bytes(b.column(0)) if t))
            held.append((h & np.uint64(BUCKETS - 1)).astype(np.int32))
            n += len(h)
            if n > BUCKETS:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        if total.any():
            parts = _coded(total).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[part] = total.get(part, 0.0) + np.exp2(np.frombuffer(counts, np.uint8) / 8) - 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_coded(x).tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    out = np.zeros((BUCKETS // WIDTH, WIDTH), np.uint8)
    for r in summed.collect():  # 4 MB, whatever the input's size
        out[r.part] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


def prefix_length(n: np.ndarray | int, similar: Fraction = SIMILAR):
    """Words of a set of n that two sets with the similarity must share one of."""
    return n - -(-n * similar.numerator // similar.denominator) + 1


def _in_order(line: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line, by line, rarity and hash."""
    order, wide = None, not len(line) or int(line[-1]) >> 28
    if not wide:  # the top of the hash is enough to bring equal words together
        order = np.argsort(line.astype(np.uint64) << np.uint64(36) | level.astype(np.uint64) << np.uint64(28) | h >> np.uint64(36))
        a, b = h[order[1:]], h[order[:-1]]
        if ((line[order[1:]] == line[order[:-1]]) & (a >> np.uint64(36) == b >> np.uint64(36)) & (a != b)).any():
            order = None
    if order is None:
        order = np.lexsort((h, level, line))
    line, h = line[order], h[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    return line[new], h[new]


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))


_POSTED = "k long, row long, line int, n int, copies long, sa long, sb long, bits long, more_bits long, prefix array<int>, at array<int>, las array<long>, lbs array<long>"
_SETS = pa.schema([("k", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("copies", pa.int64()), ("sa", pa.int64()), ("sb", pa.int64()), ("bits", pa.int64()), ("more_bits", pa.int64()), ("prefix", pa.list_(pa.int32()))])
_ROWS = pa.schema([*_SETS, ("at", pa.list_(pa.int32())), ("las", pa.list_(pa.int64())), ("lbs", pa.list_(pa.int64()))])


def _posted(docs: DataFrame, level: np.ndarray, least: int, similar: Fraction) -> DataFrame:
    """Rows of two kinds: of each text (line -1, n: lines with a word) its lines and their sets; and sets with their prefixes.

    Of each slice of the input a set comes once, with its copies counted, so that a very frequent line is few rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for b in slices(batches, 2 << 20):
            k, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            texts = [t or b"" for t in as_bytes(b.column(1))]
            first = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])])
            joined = b"\n".join(texts)
            place, h = tokens(joined)
            line = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), place)
            words = np.bincount(line, minlength=first[-1])
            n_lines = np.add.reduceat((words > 0).astype(np.int64), first[:-1]).astype(np.int32)
            if least > 1:
                keep = words[line] >= least
                line, h = line[keep], h[keep]
            line, h = _in_order(line, h, rare[(h & np.uint64(BUCKETS - 1)).astype(np.int64)])
            start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([start, [len(line)]]))
            where = line[start]
            of = np.searchsorted(first, where, side="right") - 1
            with np.errstate(over="ignore"):
                m = mixed(h + np.uint64(0x9E3779B97F4A7C15))
                half = (m & np.uint64(1)).astype(bool)
                bit = np.uint64(1) << (m >> np.uint64(58))
                sums = ((np.add, m), (np.add, mixed(m ^ h)), (np.bitwise_xor, np.where(half, 0, bit)), (np.bitwise_xor, np.where(half, bit, 0)))
                sa, sb, bits, more = (f.reduceat(x, start).view(np.int64) if len(start) else np.zeros(0, np.int64) for f, x in sums)
            bits, more = np.where(n < LARGE, bits ^ more, bits), np.where(n < LARGE, 0, more)
            within = (where - first[of]).astype(np.int32)
            per = np.bincount(of, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.full(len(texts), -1, np.int32)), pa.array(n_lines), *[pa.nulls(len(texts), f.type) for f in list(_ROWS)[4:10]], _lists(within, per), _lists(sa, per), _lists(sb, per)],
                schema=_ROWS,
            )
            order = np.lexsort((within, row[of], k[of], sb, sa))
            if len(order):
                new = np.flatnonzero(np.concatenate([[True], (sa[order[1:]] != sa[order[:-1]]) | (sb[order[1:]] != sb[order[:-1]])]))
                one, copies = order[new], np.diff(np.concatenate([new, [len(order)]]))
                # sets so small that only equal ones are similar need no posting
                size = np.where(n[one] * (similar.denominator - similar.numerator) >= similar.numerator, prefix_length(n[one], similar), 0)
                pick = np.repeat(start[one] - np.cumsum(size) + size, size) + np.arange(size.sum())
                key = (h[pick] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k[of[one]], row[of[one]], within[one], n[one].astype(np.int32), copies.astype(np.int64), sa[one], sb[one], bits[one], more[one])] + [_lists(key, size)] + [pa.nulls(len(one), f.type) for f in list(_ROWS)[10:]],
                    schema=_ROWS,
                )

    return docs.select("k", "text", "row").mapInArrow(run, _POSTED)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set, with an id: that of its first line (by k, line and row), with the copies of all."""
    held = [b for b in batches if b.num_rows]
    if held:
        b = pa.concat_batches(held)
        k, row, line, _, copies, sa, sb = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        order = np.lexsort((row, line, k, sb, sa))
        new = np.flatnonzero(np.concatenate([[True], (sa[order[1:]] != sa[order[:-1]]) | (sb[order[1:]] != sb[order[:-1]])]))
        one = b.take(pa.array(order[new])).set_column(4, "copies", pa.array(np.add.reduceat(copies[order], new)))
        at = TaskContext.get().partitionId() << 33
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + one.num_rows)), *one.columns], ["id", *one.schema.names])


def _sets(posted: DataFrame) -> DataFrame:
    """The distinct sets, each with a number of its own."""
    some = posted.filter("line >= 0").select(_SETS.names)
    tasks = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), some.count() // TASK + 1)
    dealt = some.repartition(tasks, "sa", "sb")  # a task holds its rows: their number grows with the sets
    return written(dealt.mapInArrow(_first_of_each, "id long, " + _POSTED.split(", at ")[0]), "sets")


def _blocks(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words under which very many sets are posted, and the number of blocks these are dealt into.

    A word that holds one in SHARE of all postings does so in some task too, and each task tells of those (SHARE at most).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches]
        key, n = np.unique(np.concatenate([np.zeros(0, np.int32), *held]), return_counts=True)
        many = n >= max(min(8, HOT), n.sum() / SHARE)
        yield pa.RecordBatch.from_arrays([pa.array(key[many].astype(np.int32)), pa.array(n[many].astype(np.int64))], ["key", "n"])

    found = sets.select("prefix").mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT // 2)
    rows = sorted((r.key, r.n) for r in found.orderBy(F.desc("n")).limit(4 * SHARE).collect())  # no more words can have a share
    return np.array([k for k, _ in rows], np.int32), np.array([-(-n // HOT) + 1 for _, n in rows], np.int64)


def _dealt(sets: DataFrame, blocks: tuple[np.ndarray, np.ndarray], sieve: np.ndarray | None = None) -> DataFrame:
    """Postings at (word and line), k, id, size (n, place, asks, side), bits, more_bits.

    Words of many postings are dealt into pairs of blocks, one of them the set's own; side tells which. Each pair counts as
    a word of its own. With a sieve only words in its buckets are posted.
    """
    shared = sets.sparkSession.sparkContext.broadcast((*blocks, sieve))  # bounded by SHARE and SIEVE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, many, only = shared.value
        for b in slices(batches, 2 << 20):
            prefix = b.column(b.num_columns - 1)
            size = prefix.value_lengths().to_numpy(zero_copy_only=False)
            key = prefix.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), size)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            if only is not None:
                keep = only[key & (SIEVE - 1)]
                key, of, pos = key[keep], of[keep], pos[keep]
            id_, k, line, n, bits, more, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            side = np.full(len(key), 2)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                count = np.where(hot[at] == key, many[at], 1)
                again = np.repeat(np.arange(len(key)), count)
                count = count[again]
                other = np.arange(len(again)) - np.searchsorted(again, again)
                mine = (mixed(id_[of[again]].view(np.uint64)) % count.astype(np.uint64)).astype(np.int64)
                key, of, pos = key[again], of[again], pos[again]
                cell = np.minimum(mine, other) << 31 | np.maximum(mine, other)
                named = mixed(key.astype(np.uint64) << np.uint64(32) ^ mixed(cell.view(np.uint64))).astype(np.uint32).view(np.int32)
                key = np.where(count > 1, named, key)
                side = np.where((count == 1) | (mine == other), 2, mine > other)
            packed = n[of].astype(np.int64) << 32 | pos << 3 | asks[of].astype(np.int64) << 2 | side
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.astype(np.int64) << 32 | line[of], k[of], id_[of], packed, bits[of], more[of])], ["at", "k", "id", "size", "bits", "more_bits"])

    return sets.select("id", "k", "line", "n", "bits", "more_bits", "asks", "prefix").mapInArrow(run, "at long, k long, id long, size long, bits long, more_bits long")


def partners(at: np.ndarray, k: np.ndarray, id_: np.ndarray, size: np.ndarray, bits: np.ndarray, more: np.ndarray, similar: Fraction, every: bool) -> Iterator[pa.RecordBatch]:
    """x, y, more: under each word the nearest earlier partner of each set that asks (more: it has others), or every one."""
    num, den = similar.numerator, similar.denominator
    word = at >> 32
    order = np.argsort(word)
    same = word[order[1:]] == word[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    n = size >> 32
    order = order[np.lexsort((id_[order], n[order], word[order]))]
    word, line, k, id_, n = word[order], at[order] & 0xFFFFFFFF, k[order], id_[order], n[order]
    pos, asks, side = (size[order] & 0xFFFFFFFF) >> 3, size[order] & 4 > 0, size[order] & 3
    bits, more = bits[order].view(np.uint64), more[order].view(np.uint64)
    best, dist, count = np.full(len(order), -1), np.full(len(order), 1 << 30), np.zeros(len(order), np.int64)
    tie = np.zeros(len(order), np.uint64)

    def out(a: np.ndarray, b: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(id_[a]), pa.array(id_[b]), pa.array(more)], ["x", "y", "more"])

    x, d = np.arange(len(order)), 1
    while True:
        x = x[x >= d]
        y = x - d
        near = (word[x] == word[y]) & (n[x] * num <= n[y] * den)  # sorted by size: if this one is too small, so are those before it
        x, y = x[near], y[near]
        if not len(x):
            break
        d += 1
        both = n[x] + n[y]
        spare = both - 2 * -(-num * both // (num + den))  # words that one of the sets alone may have
        ok = (2 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= both - spare) & ((side[x] == 2) | (side[x] != side[y])) & (id_[x] != id_[y])
        p, q, spare = x[ok], y[ok], spare[ok]
        one, two = bits[p] ^ bits[q], more[p] ^ more[q]
        small = (n[p] < LARGE) | (n[q] < LARGE)  # compared by 64 bits, to which those of a large set are folded
        flips = np.where(small, np.bitwise_count(one ^ two), np.bitwise_count(one).astype(np.int64) + np.bitwise_count(two)).astype(np.int64)
        later = (k[p] > k[q]) | (k[p] == k[q]) & ((line[p] > line[q]) | (line[p] == line[q]) & (id_[p] > id_[q]))
        p, q = np.where(later, p, q), np.where(later, q, p)
        ok = (flips <= spare) & asks[p]
        p, q, flips, later = p[ok], q[ok], flips[ok], later[ok]
        if every:
            if len(p):
                yield out(p, q, np.ones(len(p), bool))
            continue
        for own in (later, ~later):  # in either half a set comes once
            a, b, f = p[own], q[own], flips[own]
            count[a] += 1
            with np.errstate(over="ignore"):
                t = mixed(id_[a].view(np.uint64) * np.uint64(31) + id_[b].view(np.uint64))  # equally near ones are chosen from evenly
            better = (f < dist[a]) | (f == dist[a]) & (t < tie[a])
            a, b = a[better], b[better]
            best[a], dist[a], tie[a] = b, f[better], t[better]
    if not every:
        a = np.flatnonzero(count)
        yield out(a, best[a], count[a] > 1)


def _pairs(postings: DataFrame, total: int, similar: Fraction, every: bool) -> DataFrame:
    """x, y, more of all words, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one task's postings: their number of tasks grows with them, and no word or cell holds more than its share
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if held:
            yield from partners(*map(np.concatenate, zip(*held)), similar, every)

    tasks = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK + 1)
    found = postings.repartition(tasks, F.shiftright("at", 32)).mapInArrow(run, "x long, y long, more boolean")
    return written(found.groupBy("x", "y").agg(F.bool_or("more").alias("more")), "pairs")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, similar: Fraction) -> DataFrame:
    """x with sa, sb, k, row, line of its set, if one of its pairs is similar."""
    ends = pairs.select(F.col("x").alias("id")).unionAll(pairs.select(F.col("y").alias("id"))).distinct()
    ends = written(ends, "ends")
    held = written(sifted(sets.select("id", "k", "row", "line", "sa", "sb"), F.xxhash64("id"), ends, F.xxhash64("id")).join(ends, "id"), "held")
    wanted = held.groupBy("k", "row").agg(F.collect_list(F.struct("line", "id")).alias("lines"))
    some = sifted(docs, F.col("row"), held, F.col("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 << 20):
            ids, texts = [], []
            for t, lines in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                own = (t or b"").split(b"\n")
                for w in lines:
                    ids.append(w["id"])
                    texts.append(own[w["line"]])
            joined = b"\n".join(texts)
            place, h = tokens(joined)
            line = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), place)
            line, h = _in_order(line, h, np.zeros(len(h), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(h.view(np.int64), np.bincount(line, minlength=len(ids)))], ["id", "words"])

    words = written(some.join(wanted, ["k", "row"]).select("text", "lines").mapInArrow(run, "id long, words array<long>"), "words")
    a, b = (words.select(F.col("id").alias(c), F.col("words").alias(f"{c}words")) for c in ("x", "y"))
    both = F.size(F.array_intersect("xwords", "ywords"))
    like = both * (similar.numerator + similar.denominator) >= similar.numerator * (F.size("xwords") + F.size("ywords"))
    found = pairs.select("x", "y").join(a, "x").join(b, "y").filter(like).select("x").distinct()
    return written(found.join(held.withColumnRenamed("id", "x"), "x"), "found")


def _keyed(docs: DataFrame) -> DataFrame:
    """k (the doc_id, or LAST), text, row (a hash of the text)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))


def removed_lines(docs: DataFrame, least: int = 1, similar: Fraction = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """The rows (k, row, n_lines) of _keyed docs, and the lines removed (k, row, line, near: not equal to an earlier one)."""
    posted = written(_posted(docs, rarity(docs), least, similar), "posted")
    sets = _sets(posted)
    size = sets.agg(F.sum("copies").alias("lines"), F.sum(F.size("prefix")).alias("postings")).first()
    texts = posted.filter("line < 0").select("k", "row", F.col("n").alias("n_lines"), "at", "las", "lbs")
    blocks, asked = _blocks(sets), sets.withColumn("asks", F.lit(True))
    pairs = _pairs(_dealt(asked, blocks), size.postings or 0, similar, False)
    found = _verified(docs, sets, pairs, similar)
    open_ = written(pairs.filter("more").select(F.col("x").alias("id")).distinct().join(found.select(F.col("x").alias("id")), "id", "left_anti"), "open")
    if not open_.isEmpty():
        asked = sets.join(open_.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        asked = written(asked.select("id", "k", "line", "n", "bits", "more_bits", "prefix", "asks"), "asked")
        sieve = np.zeros(SIEVE, bool)
        buckets = asked.filter("asks").select(F.explode("prefix").alias("key")).select(F.col("key").bitwiseAND(SIEVE - 1).alias("b")).distinct()
        sieve[buckets.toArrow().column(0).to_numpy()] = True  # at most SIEVE numbers
        rest = _pairs(_dealt(asked, blocks, sieve), size.postings, similar, True)
        found = found.unionAll(_verified(docs, sets, rest, similar))
    first = ["sa", "sb", F.col("k").alias("fk"), F.col("row").alias("frow"), F.col("line").alias("fline")]
    several = sets.filter("copies > 1").select(*first, "copies", F.lit(False).alias("near"))
    near = found.select(*first, F.lit(1).cast("long").alias("copies"), F.lit(True).alias("near"))
    which = ["sa", "sb", "fk", "frow", "fline"]
    marked = written(several.unionAll(near).groupBy(*which).agg(F.max("copies").alias("copies"), F.bool_or("near").alias("near")), "marked")
    lines = texts.select("k", "row", F.explode(F.arrays_zip(F.col("at").alias("line"), F.col("las").alias("sa"), F.col("lbs").alias("sb"))).alias("l")).select("k", "row", "l.*")
    lines = sifted(lines, F.col("sa"), marked, F.col("sa"))
    often = F.col("copies") > (size.lines or 0) / SHARE  # of less than SHARE sets
    seldom = lines.join(marked.filter(~often).drop("copies"), ["sa", "sb"])
    if marked.filter(often).isEmpty():
        joined = seldom
    else:
        joined = seldom.unionByName(lines.join(F.broadcast(marked.filter(often).drop("copies")), ["sa", "sb"]))
    later = ~((F.col("fk") == F.col("k")) & (F.col("frow") == F.col("row")) & (F.col("fline") == F.col("line")))
    return texts.select("k", "row", "n_lines"), joined.filter(later | F.col("near")).select("k", "row", "line", (~later).alias("near"))


def dedup_lines(docs: DataFrame, least: int = 1, similar: Fraction = SIMILAR) -> DataFrame:
    """documents -> doc_id, n_lines (with a word), n_equal and n_near (lines removed), removed (their numbers from 0).

    Null and empty texts have no lines. Different texts under one doc_id are judged each for itself, line by line; repeated rows (equal in doc_id and text) are one document, judged alike, and keep each other's lines.
    Rows without a doc_id come last. An empty table gives no rows; other columns are ignored.
    """
    rows, gone = removed_lines(_keyed(docs), least, similar)
    per = gone.groupBy("k", "row").agg(F.sort_array(F.collect_set(F.struct("line", "near"))).alias("cut"))
    cut = F.coalesce("cut", F.array().cast("array<struct<line: int, near: boolean>>"))
    n_near = F.size(F.filter(cut, lambda x: x["near"])).cast("long")
    return rows.join(per, ["k", "row"], "left").select(F.nullif("k", F.lit(LAST)).alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), (F.size(cut) - n_near).alias("n_equal"), n_near.alias("n_near"), F.transform(cut, lambda x: x["line"].cast("long")).alias("removed"))


def without_lines(docs: DataFrame, least: int = 1, similar: Fraction = SIMILAR) -> DataFrame:
    """docs, all columns, with the removed lines taken out of text; documents of which no word is left are left out.

    Nulls, equal ids and repeated rows as in dedup_lines; texts that lose no line stay as they are, null and empty ones too.
    """
    _, gone = removed_lines(_keyed(docs), least, similar)
    cut = gone.groupBy("k", "row").agg(F.collect_set("line").alias("cut"))
    own = F.struct(*docs.columns).alias("own")
    joined = docs.select(own).select("own", F.coalesce(F.col("own.doc_id").cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(F.coalesce("own.text", F.lit(""))).alias("row")).join(cut, ["k", "row"], "left")
    places = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut"))
    kept = lambda parts: F.array_join(F.transform(places(parts), lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("own.text")).otherwise(F.get(F.transform(F.array(F.split("own.text", "\n")), kept), 0))
    left = joined.withColumn("left", text).filter(F.col("cut").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col("left").alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns])
