"""Graph operators on edge tables (src, dst): degrees, reach, cycles, components, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.session import by_key, dropped, written


def token_pairs(tokens: DataFrame, most: int = 256) -> DataFrame:
    """(a, b, shared) from (id, token): entities that share tokens held by 2 to ``most`` entities (part of the operator)."""
    # tokens and pairs are dealt out in tasks that grow with the texts
    dealt = by_key(tokens, "token", each=16)
    counted = dealt.groupBy("token").agg(F.count("*").alias("c")).filter((F.col("c") >= 2) & (F.col("c") <= most)).select("token")
    t = dealt.join(counted.hint("merge"), "token")
    u = t.select("token", F.col("id").alias("b"))
    met = t.join(u.hint("merge"), "token").filter("id < b").select(F.col("id").alias("a"), "b")
    return by_key(met, "a", "b", each=32).groupBy("a", "b").agg(F.count("*").alias("shared"))


def jaccard_edges(tokens: DataFrame, shared: int = 2, least: float = 0.2, most: int = 256) -> DataFrame:
    size = tokens.groupBy("id").agg(F.count("*").alias("n"))
    a, b = size.select(F.col("id").alias("a"), F.col("n").alias("na")), size.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    p = token_pairs(tokens, most).filter(F.col("shared") >= shared).join(a, "a").join(b, "b")
    return p.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).filter(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): least id reachable, by alternating star steps until nothing moves; each round is written to the shared folder.

    A large-star step links each node's larger neighbours to its least neighbour, a small-star step links a node and its
    smaller neighbours to the least of them; both only join and take minima, and long chains shrink by halves.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    loops = edges.filter("src = dst").select(F.col("src").alias("id"))
    e, before = written(e, "edges"), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            break
        before = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
    rooted = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    alone = loops.distinct().join(rooted, "id", "left_anti").select("id", F.col("id").alias("component"))
    return rooted.unionAll(alone)


def _labels(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(node, label): the least label of all nodes that reach a node, by rounds of propagation to the fixed point."""
    while True:
        come = edges.hint("merge").join(label.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("come"))
        new = written(label.hint("merge").join(come, "node", "left").select("node", F.least("label", F.coalesce("come", "label")).alias("label"), (F.col("come") < F.col("label")).alias("moved")), "labels")
        label = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return label


def _shortened(edges: DataFrame, worth: float = 0.1) -> tuple[DataFrame, list[DataFrame]]:
    """Edges without many of the nodes that only pass on, and those nodes (node, before, after) round by round.

    A node with one edge in and one out is on a cycle just if the nodes before and after it are in one component, so an
    edge from the one to the other may stand for it. In a round all such nodes go that come before their passing neighbours
    in an order by hash, about a third of a chain; rounds go on while they take out a share of ``worth`` of the edges.
    """
    left, rounds = written(edges, "chain"), []
    n = left.count()
    while n:
        into = left.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("src").alias("before"))
        out = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.first("dst").alias("after"))
        passing = into.filter("i = 1").hint("merge").join(out.filter("o = 1"), "node").select("node", "before", "after", F.struct(F.xxhash64("node").alias("h"), "node").alias("turn"))
        passing = written(passing, "passing")
        turn = passing.select(F.col("node").alias("other"), F.col("turn").alias("t"))
        near = passing.select("node", "turn", F.explode(F.array("before", "after")).alias("other")).hint("merge").join(turn, "other").filter("t < turn").select("node").distinct()
        gone = written(passing.hint("merge").join(near, "node", "left_anti").select("node", "before", "after"), "gone")
        dropped(passing)
        m = gone.count()
        if m < worth * n:
            dropped(gone)
            break
        rounds.append(gone)
        kept = left.hint("merge").join(gone.select(F.col("node").alias("src")), "src", "left_anti").hint("merge").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        new = written(kept.unionAll(gone.select(F.col("before").alias("src"), F.col("after").alias("dst"))).filter("src <> dst").distinct(), "chain")
        dropped(left)
        left, n = new, new.count()
    return left, rounds


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, cyclic): the least node of the strongly connected component; cyclic if it has a cycle (a loop is one).

    Chains of nodes that only pass on are shortened first, in as many rounds as the logarithm of their length.

    Nodes without an edge in or out (among those left) are components of their own and go first. Then each node takes the
    least node that reaches it; the nodes of that colour which reach the colour's node again are a component. Both run
    until nothing is left, in joins and minima over tables in the shared folder. Joins are by sorting: ids take so little room
    in files that tables of millions would be broadcast, again in each round.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()
    left, rounds = _shortened(edges.filter("src <> dst").distinct())
    found = []
    through = reduce(DataFrame.unionAll, [r.select("node") for r in rounds]) if rounds else None
    rest = written(nodes if through is None else nodes.hint("merge").join(through, "node", "left_anti"), "nodes")
    while True:
        while True:  # trim
            inner = left.select(F.col("src").alias("node")).distinct().hint("merge").join(left.select(F.col("dst").alias("node")), "node", "left_semi")
            inner = written(inner, "inner")
            n = rest.count()
            gone = rest.hint("merge").join(inner, "node", "left_anti")
            found.append(gone.select("node", F.col("node").alias("component")))
            rest = inner
            left = written(left.hint("merge").join(rest.withColumnRenamed("node", "src"), "src", "left_semi").hint("merge").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "left")
            if n == rest.count():
                break
        if rest.isEmpty():
            break
        colour = _labels(left, rest.select("node", F.col("node").alias("label")))
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("a")), colour.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        inside = written(left.hint("merge").join(a, "src").hint("merge").join(b, "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
        # backwards within each colour: those that the colour's node is reached from
        start = colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"))
        reach, front = start.filter("label is not null"), start.filter("label is not null")
        while not front.isEmpty():
            step = inside.hint("merge").join(front.select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label").distinct()
            front = written(step.hint("merge").join(reach, "node", "left_anti"), "front")
            reach = written(reach.unionAll(front), "reach")
        found.append(reach.select("node", F.col("label").alias("component")))
        rest = written(rest.hint("merge").join(reach, "node", "left_anti"), "rest")
        left = written(left.hint("merge").join(rest.withColumnRenamed("node", "src"), "src", "left_semi").hint("merge").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "left")
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    every = written(every, "strong")
    for gone in reversed(rounds):
        of = lambda c: every.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        back = gone.hint("merge").join(of("before"), "before").hint("merge").join(of("after"), "after")
        new = written(every.unionAll(back.select("node", F.when(F.col("before_in") == F.col("after_in"), F.col("before_in")).otherwise(F.col("node")))), "strong")
        dropped(every)
        dropped(gone)
        every = new
    if rounds:  # a node that was left out may be the least
        least = every.groupBy("component").agg(F.min("node").alias("least"))
        every = written(every.hint("merge").join(least, "component").select("node", F.col("least").alias("component")), "strong")
    size = every.groupBy("component").agg(F.count("*").alias("n"))
    out = every.hint("merge").join(size, "component").hint("merge").join(loops.withColumn("loop", F.lit(True)), "node", "left")
    return out.select("node", "component", ((F.col("n") > 1) | F.col("loop").isNotNull()).alias("cyclic"))


def chunks(members: DataFrame, size: int = 48) -> DataFrame:
    """Components cut into sorted chunks; a chunk of one is dropped."""
    w = Window.partitionBy("component").orderBy("id")
    c = members.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
    n = c.groupBy("component", "chunk").agg(F.count("*").alias("size")).filter("size > 1")
    return c.join(n, ["component", "chunk"])


def degrees(edges: DataFrame) -> DataFrame:
    """fan_in, fan_out and choke = fan_in * fan_out of every node, over distinct edges."""
    e = edges.distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    d = out.join(into, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return d.withColumn("choke", F.col("fan_in") * F.col("fan_out"))


def distances(edges: DataFrame) -> DataFrame:
    """(node, other, d) shortest undirected paths, by frontiers that grow a step a round until none is left.

    As many rows as there are pairs of connected nodes: meant for graphs of groups, such as chunks of components.
    """
    e = written(edges.select("src", "dst").unionAll(edges.select("dst", "src")).filter("src <> dst").distinct(), "both")
    known = front = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("d"))
    d = 1
    while not front.isEmpty():
        d += 1
        step = front.join(e, front["other"] == e["src"]).select("node", F.col("dst").alias("other")).filter("node <> other").distinct()
        front = written(step.join(known, ["node", "other"], "left_anti").withColumn("d", F.lit(d)), "front")
        known = known.unionAll(front)
    return known


def closeness(edges: DataFrame) -> DataFrame:
    """(reached - 1) / summed distance over undirected paths."""
    return distances(edges).groupBy("node").agg((F.count("*") / F.sum("d")).alias("closeness"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle (a loop is a cycle)."""
    return strong_components(edges).filter("cyclic").select("node")


def rolled_up(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Weighted edges between groups; group: (node, grp)."""
    a, b = group.select(F.col("node").alias("src"), F.col("grp").alias("a")), group.select(F.col("node").alias("dst"), F.col("grp").alias("b"))
    return edges.distinct().join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count("*").alias("weight"))
