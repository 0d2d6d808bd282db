"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

A conversation's rows are repaired by a path through the edit lattice: a node is a number of rows passed and what the
kept roles end in; a step keeps, reroles or deletes the next row or inserts one. The search is A*. What every path must
still pay, two for each row to come that has to go and two for each cut-off row (to delete it costs least), are sums over
the suffix and never more than the true rest, so the first path that reaches the end is the cheapest; the queue is ordered
by (cost plus rest, edits so far), which makes it the first one by its letters among the cheapest.

Long conversations are searched block by block: four searches a block, one from each state, give the cheapest edits from
each state to each, and blocks are joined from left to right. Rows stream through a task sorted by conversation and turn;
of a conversation no more than a block of rows and four candidates are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import SPACE

#: What edits cost: to rerole, delete, insert; a cut-off row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows of a block.
BLOCK = 512
#: States: nothing kept yet, system, user, assistant. What may follow, by the initial of a role.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: The one state that a new role leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def cheapest(rows: list[tuple[str, int]], start: int = START, ends: tuple[int, ...] = (START, ASSISTANT)) -> dict[int, tuple[int, str]]:
    """Cost and edits of the best path through rows (initial of the role, fault) to each of the states in ends that is first reached.

    With the two states that a conversation may end in, the first to be reached is the answer; with more, the search
    goes on until each has been.
    """
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] in (BLANK, DUPLICATE) else min(DELETE, CUT_OFF) if rows[i][1] == TRUNCATED else 0)
    heap, done, found = [(rest[0], "", 0, start)], set(), {}
    while heap:
        total, edits, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ends:
            found[state] = (total, edits)
            if len(found) == len(ends) or ends == (START, ASSISTANT):
                break
        cost = total - rest[i]
        heappush(heap, (cost + INSERT + rest[i], edits + "I", i, NEXT[state]))
        if i < len(rows):
            initial, fault = rows[i]
            heappush(heap, (cost + DELETE + rest[i + 1], edits + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                kept = cost + (CUT_OFF if fault == TRUNCATED else 0) + rest[i + 1]
                if (to := FOLLOWS[state].get(initial)) is not None:
                    heappush(heap, (kept, edits + "K", i + 1, to))
                heappush(heap, (kept + REROLE, edits + "R", i + 1, NEXT[state]))
    return found


def applied(rows: list[tuple[str, str]], edits: str, state: int = START) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits."""
    out, at = [], iter(rows)
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out.append((NAME[state], ""))
            continue
        role, text = next(at)
        if e == "K":
            state = FOLLOWS[state][role[:1]]
            out.append((role, text))
        elif e == "R":
            state = NEXT[state]
            out.append((NAME[state], text))
    return out


class _Paths:
    """The best path to each state over the blocks so far: cost, edits and the hash of what it leaves."""

    def __init__(self):
        self.best = {START: (0, "", hashlib.sha256(), True)}
        self.fresh = True

    def add(self, block: list[tuple[str, str, int]], whole: bool = False) -> None:
        """block: role, text and fault of rows; whole: no other block comes."""
        steps = [(role[:1], fault) for role, _, fault in block]
        ways: dict[int, tuple[int, str, int, str]] = {}
        if whole and self.fresh:
            ways = {to: (*best, START, best[1]) for to, best in cheapest(steps).items()}
            self.best = {to: (cost, edits, *self._hashed(state, block, new)) for to, (cost, edits, state, new) in ways.items()}
            return
        self.fresh = False
        for state, (cost, edits, _, _) in self.best.items():
            for to, (more, new) in cheapest(steps, state, (START, SYSTEM, USER, ASSISTANT)).items():
                way = (cost + more, edits + new, state, new)
                if to not in ways or way[:2] < ways[to][:2]:
                    ways[to] = way
        self.best = {to: (cost, edits, *self._hashed(state, block, new)) for to, (cost, edits, state, new) in ways.items()}

    def _hashed(self, state: int, block, edits: str):
        _, _, sha, empty = self.best[state]
        rows = applied([(role, text) for role, text, _ in block], edits, state)
        text = "\n".join(f"{role}:{text}" for role, text in rows)
        sha = sha.copy()
        sha.update((text if empty or not rows else "\n" + text).encode())
        return sha, empty and not rows

    def end(self) -> tuple[int, str, str]:
        cost, edits, sha, _ = min(self.best[s] for s in (START, ASSISTANT) if s in self.best)
        return cost, edits, sha.hexdigest()


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired of every conv_id that has a row.

    turns: conv_id, turn, role, text. Rows of a conversation go by turn, nulls first, then by role and text. A null role
    or text counts as one space; a null conv_id is a conversation of its own; equal rows are duplicates of the first;
    other columns are ignored; an empty table gives an empty result. Texts of any length are read whole. A row with
    a null `there` column (if turns has one) stands for a conversation without rows.

    A row is a duplicate if its role and text were seen at an earlier turn, which one aggregate tells, or just before it.
    A conversation's rows are read by one task, which its hash asks for, but not held: see above.
    """
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there"))
    rows = rows.withColumn("same", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # of rows that are met at two turns or more: the first of these
    first = F.min(F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("first")))
    seen = rows.filter("there").groupBy("conv_id", "same").agg(F.count("*").alias("n"), first.alias("f")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "f")
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    again = F.col("f").isNotNull() & ~F.col("turn").eqNullSafe(F.col("f.first"))
    ordered = rows.select("conv_id", "turn", "role", "text", "there", again.alias("again")).repartition("conv_id").sortWithinPartitions("conv_id", "there", "turn", "role", "text")

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_repaired"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for conv_id, of in groupby(told(), lambda r: r[0]):
            paths, held, count, low, high, distinct, illegal, before = _Paths(), [], [0, 0, 0, 0], None, None, 0, 0, None
            for _, turn, role, text, here, twice in of:
                if not here:
                    continue
                if turn is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                if before is not None and before[1][:1] + role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                body = text.rstrip(SPACE)
                fault = BLANK if not body else DUPLICATE if twice or before == (turn, role, text) else FINE if body[-1] in ".!?" else TRUNCATED
                count[fault] += 1
                before = (turn, role, text)
                held.append((role, text, fault))
                if len(held) == block:
                    paths.add(held)
                    held = []
            if held:
                paths.add(held, whole=True)
            cost, edits, sha = paths.end()
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((conv_id, gaps, count[BLANK], count[DUPLICATE], count[TRUNCATED], illegal, cost, edits, sha, len(edits) - edits.count("D")))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"
    return ordered.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: the rows with defects by a hash of conv_id and turn, and a row with a null in `there` for each that was dropped.

    The remainder of the CRC by 20 says which: 0 drops the row, 1 empties its text, 2 takes out its full stops, question
    and exclamation marks, 3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    space: Column = F.lit(" ")
    k = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), k.alias("k"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.when(F.col("k") == 0, False).otherwise(True))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("there"))
