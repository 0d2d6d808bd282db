"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, one over the groups' roots, and each row's proof.

Leaves are sorted by range into an RDD, so a group lies in neighbouring partitions, and a count of the rows of each
partition's first and last group says at which place of its group a partition begins. Every subtree that lies wholly
within a partition is built there. What is left over are ragged boundary nodes, fewer than two runs a level and
partition; they are shuffled by their coordinates (group, level, run) and the upper levels finished from them. A
partition then gets back the few runs above it that it doesn't hold, and gives out its rows with their proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import dropped, written

#: Nodes under one parent; leaves dealt to a partition, about.
FAN, ROWS = 16, 50_000
STEP = "struct<left: string, right: string>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The hash of a row's values: each its length in UTF-8 bytes, a colon and the value; a null is a hyphen."""
    value = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in value]), 256)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def complete(lo: int, n: int, size: int, fan: int) -> tuple[int, int]:
    """First and end of the runs that lie wholly in the n nodes from lo on, of a level of so many nodes."""
    first, end = -(-lo // fan), lo + n
    return first, max(first, -(-end // fan) if end == size else end // fan)


def grown(lo: int, total: int, nodes: list[str], fan: int) -> list[tuple[int, list[str], int]]:
    """First place, nodes and size of each level, of the subtrees over leaves from lo on, as far as they are complete."""
    levels, size = [], total
    while nodes:
        levels.append((lo, nodes, size))
        if size == 1:
            break
        first, end = complete(lo, len(nodes), size, fan)
        nodes = [digest("".join(nodes[max(0, j * fan - lo) : (j + 1) * fan - lo])) for j in range(first, end)]
        lo, size = first, -(-size // fan)
    return levels


class _Tree:
    """Trees over rows (grp string, key, leaf, tie, further columns), ascending by key and leaf within a grp; grp is never null.

    tie only lets a range end between rows that are equal.
    """

    def __init__(self, rows: DataFrame, fan: int, per: int):
        self.rows, self.fan = rows, fan
        n = max(1, -(-rows.count() // per))
        order = ["grp", "key", "leaf", "tie"]
        self.sorted = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).rdd  # its shuffle serves all three passes
        self.bounds, spanning = self._bounds()
        self._build(spanning)

    def _bounds(self) -> tuple[list[tuple[int, int, int]], int]:
        """For each partition: rows of its first group in partitions before it, rows of its first and its last group in all; the largest group over several partitions."""

        def counted(pid: int, rows: Iterator) -> Iterator:
            ends: list = []
            for grp, run in groupby(rows, lambda r: r[0]):
                ends = [*ends[:1], (grp, sum(1 for _ in run))]
            if ends:
                yield pid, ends

        totals: dict[str, int] = {}
        starts, spanning, at = {}, set(), None
        for pid, ends in sorted(self.sorted.mapPartitionsWithIndex(counted).collect()):  # two counts a partition
            starts[pid] = totals.get(ends[0][0], 0)
            if ends[0][0] == at:
                spanning.add(at)
            for grp, n in ends:
                totals[grp] = totals.get(grp, 0) + n
            at = ends[-1][0]
            starts[pid] = (starts[pid], ends[0][0], at)
        bounds = [(0, 0, 0)] * self.sorted.getNumPartitions()
        for pid, (start, first, last) in starts.items():
            bounds[pid] = (start, totals[first], totals[last])
        return bounds, max((totals[g] for g in spanning), default=0)

    def _parts(self) -> Callable:
        """(pid, rows) to (grp, place of the first row, rows of the group in all, rows here)."""
        bounds = self.bounds

        def parts(pid: int, rows: Iterator) -> Iterator:
            start, total, of_last = bounds[pid] if pid < len(bounds) else (0, 0, 0)
            held = None
            for grp, run in groupby(rows, lambda r: r[0]):
                if held:
                    yield held[0], start, total or len(held[1]), held[1]
                    start = total = 0
                held = grp, list(run)
            if held:
                yield held[0], start, total or of_last, held[1]

        return parts

    def _build(self, spanning: int) -> None:
        fan, parts, spark = self.fan, self._parts(), self.rows.sparkSession

        def ragged(pid: int, rows: Iterator) -> Iterator:
            """What other partitions need (kind 0: nodes that no complete run holds; roots) and what this one does (1: runs; 2: groups)."""
            for grp, lo, total, here in parts(pid, rows):
                yield 2, pid, grp, 0, 0, 0, None
                levels, end = grown(lo, total, [r[2] for r in here], fan), lo + len(here)
                size, k = total, 0
                while True:
                    at, nodes, _ = levels[k] if k < len(levels) else (0, [], size)
                    first, last = complete(at, len(nodes), size, fan) if nodes and size > 1 else (0, 0)
                    for i, node in enumerate(nodes, at):
                        if not first <= i // fan < last:
                            yield 0, pid, grp, k, i, size, node
                    if size == 1:
                        break
                    lo, end = lo // fan, -(-end // fan)
                    for j in {lo, end - 1}:
                        if not first <= j < last:
                            yield 1, pid, grp, k, j, 0, None
                    size, k = -(-size // fan), k + 1

        schema = "kind int, pid int, grp string, level int, idx long, size long, node string"
        told = written(spark.createDataFrame(self.sorted.mapPartitionsWithIndex(ragged), schema, verifySchema=False), "ragged")
        nodes = told.filter("kind = 0").select("grp", "level", "idx", "size", "node")
        current, roots, runs, level = nodes.filter("level = 0"), nodes.filter("size = 1").select("grp", "node"), None, 0
        made = []
        while spanning > 1:  # as many rounds as the largest group over several partitions has levels
            children = F.sort_array(F.collect_list(F.struct("idx", "node")))
            run = current.filter("size > 1").groupBy("grp", "size", F.expr(f"idx div {fan}").alias("run")).agg(children.alias("c"))
            made.append(written(run.select("grp", "size", "run", F.lit(level).alias("level"), F.col("c.node").alias("nodes")), "runs"))
            parent = made[-1].select("grp", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), F.ceil(F.col("size") / fan).alias("size"), F.sha2(F.array_join("nodes", ""), 256).alias("node"))
            roots = roots.union(parent.filter("size = 1").select("grp", "node"))
            runs = made[-1] if runs is None else runs.union(made[-1])
            level, spanning = level + 1, -(-spanning // fan)
            current = nodes.filter(F.col("level") == level).union(parent)
        self.roots = written(roots, "roots")
        asked = told.filter("kind = 1").select("pid", "grp", "level", F.col("idx").alias("run"))
        self.asked = None if runs is None else written(asked.join(runs.select("grp", "level", "run", "nodes"), ["grp", "level", "run"]), "asked")
        self.groups = told.filter("kind = 2").select("pid", "grp")
        for table in made:
            dropped(table)

    def proofs(self, above: DataFrame) -> DataFrame:
        """The rows with subroot, root and proof; above: grp, subroot, root, proof (from the subroot on) of every group."""
        fan, parts, spark = self.fan, self._parts(), self.rows.sparkSession
        top = self.groups.join(above, "grp").select("pid", "grp", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("run"), F.array("subroot", "root").alias("nodes"), "proof")
        help_ = top if self.asked is None else top.unionByName(self.asked, allowMissingColumns=True)

        def given(pid: int, pairs: Iterator) -> Iterator:
            for rows, told in pairs:
                runs = {(grp, level, run): nodes for grp, level, run, nodes, _ in told}
                tops = {grp: [tuple(s) for s in proof] for grp, level, _, _, proof in told if level == -1}
                for grp, lo, total, here in parts(pid, rows):
                    levels = grown(lo, total, [r[2] for r in here], fan)
                    sizes = [total]
                    while sizes[-1] > 1:
                        sizes.append(-(-sizes[-1] // fan))
                    paths: dict[tuple[int, int], list] = {(len(sizes) - 1, 0): tops[grp]}

                    def nodes_of(level: int, run: int) -> list[str]:
                        if (found := runs.get((grp, level, run))) is None:
                            at, nodes, _ = levels[level]
                            found = nodes[run * fan - at : (run + 1) * fan - at]
                        return found

                    def path(level: int, idx: int) -> list:
                        if (level, idx) not in paths:
                            up, nodes = path(level + 1, idx // fan), nodes_of(level, idx // fan)
                            for k in range(len(nodes)):
                                paths[level, idx // fan * fan + k] = [("".join(nodes[:k]), "".join(nodes[k + 1 :])), *up]
                        return paths[level, idx]

                    subroot, root = runs[grp, -1, 0]
                    for i, r in enumerate(here, lo):
                        yield (*r, subroot, root, path(0, i))
                        if i % fan == fan - 1:  # the run is done
                            for k in range(fan):
                                paths.pop((0, i - k), None)

        n = self.sorted.getNumPartitions()
        helps = help_.rdd.map(lambda r: (r.pid, (r.grp, r.level, r.run, r.nodes, r.proof))).partitionBy(n, int)
        rows = self.sorted
        if (more := helps.getNumPartitions() - n) > 0:  # a session may deal keys to more partitions than asked for
            rows = rows.union(spark.sparkContext.parallelize([], more))
        both = rows.mapPartitions(lambda held: [list(held)]).zip(helps.mapPartitions(lambda rows: [[x for _, x in rows]]))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema) + f", subroot string, root string, proof array<{STEP}>"
        return spark.createDataFrame(both.mapPartitionsWithIndex(given), schema, verifySchema=False)


def manifest(docs: DataFrame, fan: int = FAN, rows: int = ROWS, group: str = "source", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS, changed: Column | None = None) -> DataFrame:
    """group, key, leaf, other, subroot, root, proof of each row.

    A leaf is the hash of the row's columns; other is the leaf of the row with `changed` in the last column's place (by
    default equal to leaf). Leaves of a group ascend by key (nulls first), equal keys by leaf; groups by their bytes, null
    first. proof is an array of (left, right), the hashes of a node's siblings before and after it in its run, put
    together, from the leaf up to the root; folded() leads a leaf back to the root. Repeated rows are leaves of their own
    and an empty table gives an empty result; other columns are ignored. Texts are read once and not moved: hashes are.
    """
    values = [F.col(c) for c in columns]
    own = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group)))
    hashes = docs.select(own.alias("grp"), F.col(key).alias("key"), leaf(*values).alias("leaf"), (leaf(*values) if changed is None else leaf(*values[:-1], changed)).alias("other")).withColumn("tie", F.monotonically_increasing_id())
    kind = docs.schema[key].dataType.simpleString()
    out = ["group", "key", "leaf", "other", "subroot", "root", "proof"]
    leaves = written(hashes, "leaves")
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], f"group string, key {kind}, leaf string, other string, subroot string, root string, proof array<{STEP}>")
    below = _Tree(leaves, fan, rows)
    upper = _Tree(below.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("node").alias("leaf"), F.lit(0).alias("tie")), fan, rows)
    alone = upper.roots.select("grp", F.col("node").alias("subroot"), F.col("node").alias("root"), F.expr(f"cast(array() as array<{STEP}>)").alias("proof"))
    above = upper.proofs(alone).select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "root", "proof")
    found = below.proofs(written(above, "above"))
    return found.withColumn("group", F.when(F.col("grp") != "", F.expr("substr(grp, 2)"))).select(*out)
