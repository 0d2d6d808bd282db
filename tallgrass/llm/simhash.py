"""SimHash near-duplicates by a tiled exact comparison of fingerprints.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes of the text's word shingles. Distinct
fingerprints are sorted by their population count and the counts of their eight bytes, and cut into tiles. Two
fingerprints whose counts (in all, or summed over the bytes) differ by more than the radius cannot be within it, so
tile pairs whose counts lie too far apart are skipped; all others are compared in full with numpy's exclusive-or and
bit counts. Nothing is lost, and copies of a text are one fingerprint, so that a large group of copies costs nothing.
Links found in one tile pair are sent on as a spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import as_bytes, sifted, slices, written
from tallgrass.llm.components import components

TILE = 16384  # fingerprints moved together
SUB = 256  # fingerprints compared together
CHUNK = 1 << 16  # shingles whose bits are counted at once
SIMILAR, COVERS = Fraction(4, 5), 20  # similarity of sets of shingles that are linked; bits that cover it
COUNTS = 64  # counters of a set's shingles
MOST_EACH = 16  # candidates of one set in a tile pair that are passed on at once


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a whole text: A-Z lower-cased, words joined by one space, repeats counted (no word: zero)."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _hashes(text, shingle, seed):
        ones += _ones(h)
        n += len(h)
    return _majority(ones, n)


def _hashes(text: bytes | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The shingles' hashes in order, in parts; none for a text without a word."""
    w = (text or b"").lower().split()  # bytes: only A-Z change, only the six ASCII separators split
    if not w:
        return
    joined = b" ".join(w)
    n = max(1, len(w) - shingle + 1)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    start = np.concatenate([[0], end[:-1]])[:n].tolist()
    stop = (end[min(shingle, len(w)) - 1 :] - 1).tolist()
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    for i in range(0, n, CHUNK):
        part = [joined[a:b] for a, b in zip(start[i : i + CHUNK], stop[i : i + CHUNK])]
        yield np.fromiter(map(hashed, part), np.uint64, len(part))


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in as_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _bytes_ones(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint8).reshape(-1, 8)).astype(np.int16)


def _tiles(fps: DataFrame, tile: int) -> DataFrame:
    """Tiles of the sorted distinct fingerprints; ids follow the sorting."""
    byte = lambda i: F.bit_count(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255))
    key = F.bit_count("fp").cast("long") * (1 << 32)
    for i in range(8):
        key = key + byte(i).cast("long") * (1 << (28 - 4 * i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = TaskContext.get().partitionId() << 32, np.zeros(0, np.uint64)
        names = ["tile", "t_lo", "t_hi", "b_lo", "b_hi", "data"]

        def out(x: np.ndarray) -> pa.RecordBatch:
            ones = _bytes_ones(x)
            total = ones.sum(axis=1)
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([int(total.min())], pa.int32()), pa.array([int(total.max())], pa.int32()), pa.array([ones.min(axis=0).tolist()], kind), pa.array([ones.max(axis=0).tolist()], kind), pa.array([x.tobytes()], pa.binary())], names)

        for b in batches:
            held = np.concatenate([held, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            while len(held) >= tile:
                yield out(held[:tile])
                k, held = k + 1, held[tile:]
        if len(held):
            yield out(held)

    ranged = fps.select("fp", key.alias("key")).repartitionByRange(F.col("key"), F.col("fp")).sortWithinPartitions("key", "fp")
    return ranged.select("fp").mapInArrow(run, "tile long, t_lo int, t_hi int, b_lo array<int>, b_hi array<int>, data binary")


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least difference of counts between each box of a and each of b, summed over the bytes."""
    return np.maximum(0, np.maximum(lo_b[None] - hi_a[:, None], lo_a[:, None] - hi_b[None])).sum(axis=2)


def forest(u: np.ndarray, v: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable node of each of n nodes, from edges (and labels found before)."""
    label = np.arange(n) if label is None else label
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tolist() != label.tolist():
            label = up
    return label


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int, sub: int = SUB, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius of two tiles, as (fp, root fp)."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    cut_a, cut_b = np.arange(0, len(a), sub), np.arange(0, len(b), sub)
    ones_a, ones_b = _bytes_ones(a), _bytes_ones(b)
    near = _gap(np.minimum.reduceat(ones_a, cut_a), np.maximum.reduceat(ones_a, cut_a), np.minimum.reduceat(ones_b, cut_b), np.maximum.reduceat(ones_b, cut_b)) <= radius
    if same:
        near = np.triu(near)
    label, us, vs, held = np.arange(len(both)), [], [], 0
    for i, j in zip(*np.nonzero(near)):
        x, y = a[cut_a[i] : cut_a[i] + sub], b[cut_b[j] : cut_b[j] + sub]
        hit = np.bitwise_count(x[:, None] ^ y[None]) <= radius
        if same and i == j:
            np.fill_diagonal(hit, False)
        if hit.any():
            p, q = np.nonzero(hit)
            us.append(p + cut_a[i])
            vs.append(q + cut_b[j] + shift)
            held += len(p)
            if held > most:
                label, us, vs, held = forest(np.concatenate(us), np.concatenate(vs), len(both), label), [], [], 0
    if us:
        label = forest(np.concatenate(us), np.concatenate(vs), len(both), label)
    moved = np.nonzero(label != np.arange(len(both)))[0]
    return both[moved], both[label[moved]]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v): a forest that joins all distinct fingerprints which a chain of steps within the radius joins.

    fps: a column fp of distinct longs. Tile pairs are found by an equi-join on the population counts that two
    tiles may share within the radius, on the tiles' bounds alone; the tiles' data then follow the pairs kept.
    """
    tiles = written(_tiles(fps, tile), "tiles")
    meta = tiles.drop("data")
    level = lambda lo, hi: F.explode(F.sequence(F.col(lo), F.col(hi))).alias("level")
    low = meta.select("*", level("t_lo", "t_hi"))
    high = meta.select(*[F.col(c).alias(f"_{c}") for c in meta.columns]).select("*", F.explode(F.sequence(F.col("_t_lo") - radius, F.col("_t_hi"))).alias("level"))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, i: s + F.greatest(F.lit(0), F.get("_b_lo", i) - F.get("b_hi", i), F.get("b_lo", i) - F.get("_b_hi", i)))
    pairs = low.join(high, "level").filter(F.col("tile") <= F.col("_tile")).filter(gap <= radius).select("tile", "_tile").distinct()
    sides = pairs.join(tiles.select("tile", "data"), "tile").join(tiles.select(F.col("tile").alias("_tile"), F.col("data").alias("_data")), "_tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, q, a, b = (batch.column(c)[i].as_py() for c in range(4))
                u, v = tile_links(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), p == q, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    spread = sides.select("tile", "_tile", "data", "_data").repartition("tile", "_tile")
    return spread.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, tile: int = TILE) -> DataFrame:
    """documents -> (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows fall together; an empty
    table gives no rows. Other columns are ignored.
    """
    of = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = of.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = written(links(distinct.select("fp"), radius, tile), "links")
    root = components(found)
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = written(rooted.join(low, "root").select("fp", "component_id"), "components")
    return of.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ---- groups by verified similarity ----------------------------------------------------------------------------------

_PAIR = "x long, y long, more boolean"


def _shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    parts = list(_hashes(text, shingle, seed))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) if len(h) else 0


def shingle_sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, row) -> sh: hash of the set of shingles, n: its size, fp: its fingerprint, counts: of its shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sh, n, fp, counts = [], [], [], []
            for t in as_bytes(b.column(2)):
                h = _shingle_set(t, shingle, seed)
                sh.append(_set_id(h))
                n.append(len(h))
                fp.append(_majority(sum((_ones(h[i : i + CHUNK]) for i in range(0, len(h), CHUNK)), np.zeros(64, np.int64)), len(h)))
                counts.append(np.minimum(255, np.bincount((h >> np.uint64(32)) % COUNTS, minlength=COUNTS)).astype(np.uint8).tobytes())
            signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (sh, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed[0], pa.array(n, pa.int64()), signed[1], pa.array(counts, pa.binary())], ["doc_id", "row", "sh", "n", "fp", "counts"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, sh long, n long, fp long, counts binary")


_UNIT = np.dtype([("sh", "<i8"), ("label", "<i8"), ("fp", "<u8"), ("n", "<i4"), ("asks", "?"), ("counts", "u1", COUNTS)])


def _set_tiles(units: DataFrame, tile: int) -> DataFrame:
    """Tiles of sets (sh, label, fp, n, asks, counts) sorted by size: tile, lo, hi, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = TaskContext.get().partitionId() << 32, np.zeros(0, _UNIT)

        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([int(x["n"].min())], pa.int64()), pa.array([int(x["n"].max())], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["tile", "lo", "hi", "data"])

        for b in batches:
            new = np.zeros(b.num_rows, _UNIT)
            for name in ("sh", "label", "n", "asks"):
                new[name] = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            new["fp"] = b.column(b.schema.get_field_index("fp")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            new["counts"] = np.frombuffer(b"".join(b.column(b.schema.get_field_index("counts")).to_pylist()), np.uint8).reshape(-1, COUNTS)
            held = np.concatenate([held, new])
            while len(held) >= tile:
                yield out(held[:tile])
                k, held = k + 1, held[tile:]
        if len(held):
            yield out(held)

    return units.repartitionByRange(F.col("n"), F.col("sh")).sortWithinPartitions("n", "sh").mapInArrow(run, "tile long, lo long, hi long, data binary")


def set_candidates(a: np.ndarray, b: np.ndarray, same: bool, radius: int, similar: Fraction, most: int | None, sub: int = SUB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, more: pairs of b's and a's sets (y before x if both are one tile) that may be similar.

    They lie within the radius, their sizes allow the similarity, and so do the differences of their counts, which are no
    more than the sets' symmetric difference. Of a set with over ``most`` partners the first and the nearest are passed on,
    with more set.
    """
    num, den = similar.numerator, similar.denominator
    xs, ys, mores = [], [], []
    for j in range(0, len(b), sub):
        v = b[j : j + sub]
        if not v["asks"].any():
            continue
        px, py, pd = [], [], []
        for i in range(0, j + sub if same else len(a), sub):
            u = a[i : i + sub]
            if not len(u) or int(u["n"].max()) * den < int(v["n"].min()) * num or int(v["n"].max()) * den < int(u["n"].min()) * num:
                continue
            q, p = np.nonzero(np.bitwise_count(v["fp"][:, None] ^ u["fp"][None]) <= radius)
            nu, nv = u["n"][p].astype(np.int64), v["n"][q].astype(np.int64)
            ok = v["asks"][q] & (v["label"][q] != u["label"][p]) & (nu * den >= nv * num) & (nv * den >= nu * num)
            if same:
                ok &= p + i < q + j
            q, p, both = q[ok], p[ok], (nu + nv)[ok]
            least = -(-num * both // (num + den))
            for s in range(0, len(p), CHUNK):
                e = slice(s, s + CHUNK)
                apart = np.abs(v["counts"][q[e]].astype(np.int16) - u["counts"][p[e]]).sum(axis=1, dtype=np.int64)
                ok = apart <= both[e] - 2 * least[e]
                px.append(q[e][ok])
                py.append(p[e][ok] + i)
                pd.append(apart[ok])
        if not px:
            continue
        x, y, d = (np.concatenate(z) for z in (px, py, pd))
        many = np.zeros(len(x), bool) if most is None else np.bincount(x, minlength=len(v))[x] > most
        keep = ~many
        for order in (np.lexsort((y, x)), np.lexsort((y, d, x))):
            first = np.concatenate([[True], x[order][1:] != x[order][:-1]]) if len(x) else np.zeros(0, bool)
            keep[order[first]] = True
        xs.append(v["sh"][x[keep]])
        ys.append(a["sh"][y[keep]])
        mores.append(many[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys]), np.concatenate([none.astype(bool), *mores])


def _candidates(units: DataFrame, radius: int, similar: Fraction, tile: int, most: int | None) -> DataFrame:
    """x, y, more of all tile pairs whose sizes allow the similarity."""
    num, den = similar.numerator, similar.denominator
    tiles = written(_set_tiles(units, tile), "tiles")
    meta = tiles.drop("data")
    # sizes by steps of the similarity: sets that may be similar stand at most one step apart (two, for rounding)
    step = lambda c: F.floor(F.ln(F.col(c).cast("double")) / math.log(den / num)).cast("int")
    low = meta.select("*", F.explode(F.sequence(step("lo"), step("hi"))).alias("step"))
    high = meta.select(*[F.col(c).alias(f"_{c}") for c in meta.columns]).select("*", F.explode(F.sequence(step("_lo") - 2, step("_hi") + 2)).alias("step"))
    fits = (F.col("tile") <= F.col("_tile")) & (F.col("hi") * den >= F.col("_lo") * num) & (F.col("_hi") * den >= F.col("lo") * num)
    pairs = written(low.join(high, "step").filter(fits).select("tile", "_tile").distinct(), "tilepairs")
    sides = pairs.join(tiles.select("tile", "data"), "tile").join(tiles.select(F.col("tile").alias("_tile"), F.col("data").alias("_data")), "_tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, q, a, b = (batch.column(c)[i].as_py() for c in range(4))
                found = set_candidates(np.frombuffer(a, _UNIT), np.frombuffer(b, _UNIT), p == q, radius, similar, most)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in found], ["x", "y", "more"])

    n = pairs.count()
    spread = sides.select("tile", "_tile", "data", "_data").repartition(max(1, min(n, 2048), -(-n // 64)), "tile", "_tile")
    return spread.mapInArrow(run, _PAIR)


def _similar(docs: DataFrame, of: DataFrame, pairs: DataFrame, shingle: int, seed: int, similar: Fraction) -> DataFrame:
    """x, y: the pairs whose sets of shingles, made again from one text each, have the similarity."""
    ends = pairs.select(F.col("x").alias("sh")).unionAll(pairs.select(F.col("y").alias("sh"))).distinct()
    wanted = of.join(ends, "sh").groupBy("sh").agg(F.min(F.struct("doc_id", "row")).alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.row").alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [_shingle_set(t, shingle, seed) for t in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_set_id(h) for h in sets], np.uint64).view(np.int64)), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["sh", "words"])

    wanted = written(wanted, "wanted")
    some = sifted(docs, F.col("row"), wanted, F.col("_row"))
    texts = some.join(wanted, some["doc_id"].eqNullSafe(wanted["_id"]) & (some["row"] == wanted["_row"]), "left_semi").select("text")
    sets = written(texts.mapInArrow(run, "sh long, words array<long>"), "sets")  # a repeated row gives its set again
    a, b = (sets.select(F.col("sh").alias(c), F.col("words").alias(f"{c}words")) for c in ("x", "y"))
    both = F.size(F.array_intersect("xwords", "ywords"))
    like = both * (similar.numerator + similar.denominator) >= similar.numerator * (F.size("xwords") + F.size("ywords"))
    return pairs.select("x", "y").join(a, "x").join(b, "y").filter(like).select("x", "y").distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, radius: int = COVERS, similar: Fraction = SIMILAR, seed: int = 42, tile: int | None = None, most: int = MOST_EACH) -> DataFrame:
    """documents -> (doc_id, row, component): rows (row: hash of the text) joined by a chain of similar sets of shingles.

    Sets of distinct shingles are compared by fingerprints in tiles, and pairs within the radius are linked if their exact
    Jaccard similarity suffices. Texts without a word are one set; fewer words than a shingle are one shingle; null and
    repeated doc_ids are rows like others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    of = written(shingle_sets(docs, shingle, seed), "shingles")
    units = written(of.filter("n > 0").select("sh", "n", "fp", "counts").dropDuplicates(["sh"]), "units")
    tile = tile or min(1 << 16, max(2048, units.count() // 24))  # the tiles moved grow with the number of tile pairs
    first = units.select("*", F.col("sh").alias("label"), F.lit(True).alias("asks"))
    pairs = written(_candidates(first, radius, similar, tile, most), "pairs")
    linked = written(_similar(docs, of, pairs, shingle, seed, similar), "linked")
    root = components(linked.select(F.col("x").alias("u"), F.col("y").alias("v")))
    asks = pairs.filter("more").select(F.col("x").alias("sh")).distinct().withColumn("asks", F.lit(True))
    if not asks.isEmpty():  # sets with many partners: those of other groups are compared one and all
        again = units.join(root.select(F.col("node").alias("sh"), F.col("root").alias("label")), "sh", "left").join(asks, "sh", "left")
        again = again.withColumn("label", F.coalesce("label", "sh")).withColumn("asks", F.coalesce("asks", F.lit(False)))
        rest = written(_candidates(again, radius, similar, tile, None).join(pairs.select("x", "y"), ["x", "y"], "left_anti"), "pairs")
        linked = linked.unionAll(written(_similar(docs, of, rest, shingle, seed, similar), "linked"))
        root = components(linked.select(F.col("x").alias("u"), F.col("y").alias("v")))
    rooted = of.select("doc_id", "row", "sh").join(root.withColumnRenamed("node", "sh"), "sh", "left")
    return rooted.select("doc_id", "row", F.coalesce("root", "sh").alias("component"))
