"""How a crowded folder is divided: exact bipartition of few nodes, label propagation and refinement of many.

Nodes are (dir, node, loc) and edges (dir, src, dst, weight) within a folder. Folders of up to eight nodes are divided by
trying every subset as a bit mask; larger ones by votes and moves that are joins over all folders at once, so neither
the number of folders nor the size of one is bounded by a task. Nodes are unique within a folder and none is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.session import dropped, written

#: Nodes tried exhaustively, tolerance, lines of a part, parts, rounds of votes and moves.
FEW, TOLERANCE, PART_LOC, PARTS, VOTES, MOVES = 8, 0.25, 1000, (2, 4), 100, 10
#: Words that name nothing, names of parts without a word of their own.
IDLE, NAMES = ("file", "test", "spec"), ("core", "io", "api", "util")


def parts_wanted(nodes: DataFrame) -> DataFrame:
    """dir, n, loc, k: two to four parts of about a thousand lines."""
    k = F.least(F.greatest(F.round(F.sum("loc") / PART_LOC).cast("int"), F.lit(PARTS[0])), F.lit(PARTS[1]))
    return nodes.groupBy("dir").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"), k.alias("k"))


def weights(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, those of a pair and direction added up."""
    return edges.filter("src <> dst").groupBy("dir", "src", "dst").agg(F.sum("weight").alias("weight"))


def bipartitions(nodes: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(dir, node, part) of folders of two to eight nodes: the subset with the lightest edges out of it.

    A subset is a bit mask over the nodes in order of their names. Its share of the lines may differ from a half by the
    tolerance; of equal cuts the more even one, then the lower mask is taken. If no subset is even enough, the first half
    of the nodes is split off. Every folder has at most 254 masks, weighed within its row over its few nodes; only the best
    becomes a column, and all that is grouped or joined is so by folder, so tables dealt out by folder stay where they are.
    """
    held = nodes.groupBy("dir").agg(F.count("*").alias("n")).filter(F.col("n").between(2, FEW)).select("dir")
    n = nodes.join(held, "dir").groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("node", "loc"))).alias("ns"))
    es = weights(edges.join(held, "dir", "left_semi")).groupBy("dir").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("named"))
    at = lambda c: F.array_position("ns.node", c) - 1
    x = n.join(es, "dir", "left")
    x = x.withColumn("es", F.filter(F.transform("named", lambda e: F.struct(at(e["src"]).alias("i"), at(e["dst"]).alias("j"), e["weight"].alias("weight"))), lambda e: (e["i"] >= 0) & (e["j"] >= 0)))
    x = x.withColumn("es", F.coalesce("es", F.expr("cast(array() as array<struct<i: bigint, j: bigint, weight: bigint>>)"))).drop("named")
    x = x.withColumn("total", F.aggregate("ns", F.lit(0).cast("long"), lambda s, v: s + v["loc"]))

    def bit(mask: Column, i: Column) -> Column:
        return F.call_function("shiftright", mask, i.cast("int")).bitwiseAND(F.lit(1)) != 0

    def weighed(mask: Column) -> Column:
        own = F.aggregate(F.transform("ns", lambda v, i: F.when(bit(mask, i), v["loc"]).otherwise(0)), F.lit(0).cast("long"), lambda s, v: s + v)
        cut = F.aggregate("es", F.lit(0).cast("long"), lambda s, e: s + F.when(bit(mask, e["i"]) & ~bit(mask, e["j"]), e["weight"]).otherwise(0))
        return F.struct(cut.alias("cut"), F.when(F.col("total") > 0, F.abs(own / F.col("total") - 0.5)).otherwise(0.0).alias("uneven"), mask.alias("mask"))

    masks = F.sequence(F.lit(1), F.expr("cast(shiftleft(1, size(ns)) - 2 as int)"))
    best = F.array_min(F.filter(F.transform(masks, weighed), lambda w: w["uneven"] <= tolerance))
    half = F.expr("cast(shiftleft(1, size(ns) div 2) - 1 as int)")
    b = x.select("dir", "ns", best.alias("best")).select("dir", F.coalesce("best.mask", half).alias("mask"), F.posexplode("ns.node").alias("at", "node"))
    return b.select("dir", "node", F.when(F.col("mask").bitwiseAND(F.expr("shiftleft(1, at)")) != 0, 0).otherwise(1).alias("part"))


def round_robin(nodes: DataFrame, k: DataFrame) -> DataFrame:
    """(dir, node, part): the nodes of small folders dealt in order to k parts."""
    at = F.row_number().over(Window.partitionBy("dir").orderBy("node")) - 1  # eight nodes at most
    return nodes.join(k.filter(F.col("n") <= FEW).select("dir", "k"), "dir").withColumn("at", at).select("dir", "node", (F.col("at") % F.col("k")).alias("part"))


def labels(nodes: DataFrame, edges: DataFrame, rounds: int = VOTES) -> DataFrame:
    """(dir, node, label): each node takes the label with the most weight among the nodes it points to, again and again.

    A node without edges out keeps its own, a node changes only where its own label has less weight than the best one, and
    of equal ones the least is taken. In a round all nodes that would change are found at once, and those of them change
    that come before every such node they are joined to, in the order of (CRC-32 of the name, name): so no two neighbours
    swap labels, and a round is what some sequence of single votes gives. It ends when none would change, or after
    ``rounds`` rounds. A folder in which none would change stays as it is, so such folders are left out of later rounds,
    each time that they are half of those left.
    """
    e = written(weights(edges), "edges")
    settled, most = [], nodes.select("dir").distinct().count()
    current = written(nodes.select("dir", "node", F.col("node").alias("label")), "labels")
    order = F.struct(F.crc32("node").alias("crc"), F.col("node"))
    for _ in range(rounds):
        votes = e.join(current.select("dir", F.col("node").alias("dst"), "label"), ["dir", "dst"]).groupBy("dir", "src", "label").agg(F.sum("weight").alias("w"))
        held = votes.join(current.select("dir", F.col("node").alias("src"), F.col("label").alias("own")), ["dir", "src"])
        best = held.groupBy("dir", F.col("src").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best"), F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("w"))), F.lit(0)).alias("own"))
        would = written(best.filter(-F.col("best.w") > F.col("own")).select("dir", "node", F.col("best.label").alias("to"), order.alias("turn")), "would")
        if would.isEmpty():
            dropped(would)
            break
        a, b = would.select("dir", F.col("node").alias("src"), F.col("turn").alias("s")), would.select("dir", F.col("node").alias("dst"), F.col("turn").alias("t"))
        waits = e.join(a, ["dir", "src"]).join(b, ["dir", "dst"]).select("dir", F.when(F.col("s") > F.col("t"), F.col("src")).otherwise(F.col("dst")).alias("node")).distinct()
        moves = would.join(waits, ["dir", "node"], "left_anti").select("dir", "node", "to")
        new = written(current.join(moves, ["dir", "node"], "left").select("dir", "node", F.coalesce("to", "label").alias("label")), "labels")
        dropped(current)
        current = new
        moving = would.select("dir").distinct()
        left = moving.count()
        if 2 * left <= most:
            settled.append(written(current.join(moving, "dir", "left_anti").select(current.columns), "settled"))
            fewer, most = written(e.join(moving, "dir", "left_semi").select(e.columns), "edges"), left
            new = written(current.join(moving, "dir", "left_semi").select(current.columns), "labels")
            dropped(e)
            dropped(current)
            e, current = fewer, new
        dropped(would)
    dropped(e)
    return reduce(DataFrame.unionAll, [*settled, current])


def to_parts(found: DataFrame, k: DataFrame) -> DataFrame:
    """(dir, node, part) with k parts of each folder, from its labels.

    With too many labels the smallest two are put together until k are left, which is the same as keeping the order of
    sizes in a heap of (size, name): the number of labels of a folder is all that is held, not its nodes. With too few the
    largest is halved, in the order of its nodes' names, until there are k or it has less than two nodes.
    """
    sizes = found.groupBy("dir", "label").agg(F.count("*").alias("n"))
    plan = sizes.join(k.select("dir", "k"), "dir").groupBy("dir", "k").agg(F.collect_list(F.struct("n", "label")).alias("c"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *x) for d, c, k in zip(b.dir, b.c, b.k) for x in shares([(int(x["n"]), x["label"]) for x in c], int(k))]
            yield pd.DataFrame(rows, columns=["dir", "label", "part", "first", "until"]).astype({"until": "Int64"})

    to = plan.select("dir", "c", "k").mapInPandas(merge, "dir string, label string, part int, first long, until long")
    placed = found.withColumn("at", F.row_number().over(Window.partitionBy("dir", "label").orderBy("node")) - 1)
    # a label that is halved has a row for each share of it
    return placed.join(to, ["dir", "label"]).filter((F.col("at") >= F.col("first")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).select("dir", "node", "part")


def shares(sizes: list[tuple[int, str]], k: int) -> list[tuple[str, int, int, int | None]]:
    """(label, part, first, until): which nodes of each label, counted in order, go to which of k parts."""
    heap = [(n, label, [(label, 0, None)]) for n, label in sizes]
    heapify(heap)
    while len(heap) > k:
        a, b = heappop(heap), heappop(heap)
        heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    while len(heap) < k and heap:
        n, name, held = largest = max(heap)
        if n < 2:
            break
        heap.remove(largest)
        label, first, until = held[0]  # there were fewer labels than parts, so each is whole or a share of one
        mid = first + n // 2
        heap += [(n // 2, name, [(label, first, mid)]), (n - n // 2, name + "\0", [(label, mid, until)])]
    return [(label, part, first, until) for part, (_, _, held) in enumerate(sorted(heap, key=lambda x: x[1])) for label, first, until in held]


def refined(parts: DataFrame, edges: DataFrame, passes: int = MOVES) -> DataFrame:
    """(dir, node, part) after moves of single nodes that lower the cut.

    A pass goes over the pairs of parts in order; for each, the one node that gains most by changing sides moves, if it
    gains: its edges to the other part less those to its own. Of equal gains one of the first part, then the least node
    moves. It ends when a pass moves none. Every folder's best node is found by one aggregate, all folders at once; a folder
    in which a pass moved none is left out of later passes.
    """
    e = written(weights(edges), "edges")
    current, settled = written(parts.withColumn("moves", F.lit(0)), "parts"), []
    most = current.agg(F.max("part")).first()[0] or 0
    for _ in range(passes):
        for i in range(most + 1):
            for j in range(i + 1, most + 1):
                sides = current.filter(F.col("part").isin(i, j))
                to = sides.select("dir", F.col("node").alias("dst"), F.col("part").alias("there"))
                gain = F.sum(F.when(F.col("there") == F.col("part"), -F.col("weight")).otherwise(F.col("weight")))
                g = e.join(sides.select("dir", F.col("node").alias("src"), "part"), ["dir", "src"]).join(to, ["dir", "dst"]).groupBy("dir", "src", "part").agg(gain.alias("gain")).filter("gain > 0")
                best = g.groupBy("dir").agg(F.min(F.struct((-F.col("gain")).alias("g"), "part", "src")).alias("b")).select("dir", F.col("b.src").alias("node"), (F.lit(i + j) - F.col("b.part")).alias("to"))
                new = written(current.join(best, ["dir", "node"], "left").select("dir", "node", F.coalesce("to", "part").alias("part"), (F.col("moves") + F.col("to").isNotNull().cast("int")).alias("moves")), "parts")
                dropped(current)
                current = new
        moved = written(current.filter("moves > 0").select("dir").distinct(), "moved")
        settled.append(written(current.join(moved, "dir", "left_anti").select("dir", "node", "part"), "settled"))
        rest = written(current.join(moved, "dir", "left_semi").select("dir", "node", "part", F.lit(0).alias("moves")), "parts")
        fewer = written(e.join(moved, "dir", "left_semi").select(e.columns), "edges")
        for t in (e, current, moved):
            dropped(t)
        e, current = fewer, rest
        if current.isEmpty():
            break
    dropped(e)
    return reduce(DataFrame.unionAll, [*settled, current.select("dir", "node", "part")])


def divided(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dir, node, part) of all folders: two parts of eight nodes at most exactly, more parts of so few by turns, others by votes and moves."""
    k = written(parts_wanted(nodes), "wanted")
    small = k.filter(F.col("n") <= FEW)
    two = nodes.join(small.filter("k = 2 and n >= 2").select("dir"), "dir")
    turns = nodes.join(small.filter("k > 2 or n < 2").select("dir"), "dir")
    large = k.filter(F.col("n") > FEW).select("dir")
    many, own = nodes.join(large, "dir"), edges.join(large, "dir", "left_semi")
    moved = refined(to_parts(labels(many, own), k), own)
    return bipartitions(two, edges.join(two.select("dir").distinct(), "dir", "left_semi")).unionByName(round_robin(turns, k)).unionByName(moved)


def named(parts: DataFrame, nodes: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """dir, part, name, files, loc: a part's name is the most frequent word of its files' stems (twice at least), else one of a list.

    Words are cut at ``_``, ``-`` and ``.``, have three letters and more and are no number; of equal ones the least is taken.
    """
    p = parts.join(nodes.select("dir", "node", "loc"), ["dir", "node"])
    stem = F.regexp_replace(F.regexp_replace("node", "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    words = p.select("dir", "part", F.explode(F.split(F.lower(stem), "[_.-]")).alias("word")).filter((F.length("word") > 2) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(*IDLE))
    best = words.groupBy("dir", "part", "word").agg(F.count("*").alias("c")).filter("c > 1").groupBy("dir", "part").agg(F.min(F.struct((-F.col("c")).alias("c"), "word")).alias("b"))
    of = p.groupBy("dir", "part").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    fall = F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), F.col("part")), F.concat(F.lit("partition_"), F.col("part")))
    return of.join(best, ["dir", "part"], "left").select("dir", "part", F.coalesce("b.word", fall).alias("name"), "files", "loc")


def crossing_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """dir, crossing: weight of the edges between parts, and moved: files; effort is twice the crossing weight beside the files."""
    a = parts.select("dir", F.col("node").alias("src"), F.col("part").alias("p"))
    b = parts.select("dir", F.col("node").alias("dst"), F.col("part").alias("q"))
    w = weights(edges).join(a, ["dir", "src"]).join(b, ["dir", "dst"]).filter("p <> q").groupBy("dir").agg(F.sum("weight").alias("crossing"))
    return parts.groupBy("dir").agg(F.count("*").alias("moved")).join(w, "dir", "left").select("dir", "moved", F.coalesce("crossing", F.lit(0).cast("long")).alias("crossing"))
