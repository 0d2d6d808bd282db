"""Vector bin packing of examples into training sequences.

An example needs tokens, one segment, and loss-bearing tokens; a sequence has a limit on each. Whole multiples of the
sequence length are cut from long examples first. Unless a limit on segments is given there is none besides that of tokens
(a segment has a token), so that very short texts fill their sequences too. What remains is packed from a bounded pool by the dot-product
heuristic: of the pool's items that fit, the next is the one whose needs have the greatest dot product with the
sequence's free capacity, both as shares of the limits. When nothing fits whole, a piece that fills the sequence
exactly is cut from the item of most tokens (if examples may be cut). The last sequences of a partition are cut to powers of two,
so that they need no padding either.

Each partition is packed on its own, in one pass: no shuffle, memory bounded by the pool, and a lost task is redone
alone. Sequence ids carry the partition's number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import as_bytes, slices
from tallgrass.llm.tokens import encoder

POOL = 512


class Packer:
    """Places items into sequences; an item is (key, tokens, loss), the key being anything."""

    def __init__(self, tokens: int = 2048, segments: int | None = None, loss: int | None = None, cut: bool = True, pool: int = POOL, first: int = 0):
        self.limit = np.array([tokens, segments or tokens, loss or tokens], np.int64)
        self.tokens, self.cut, self.most, self.sequence = tokens, cut, pool, first
        self.keys, self.need = [], np.zeros((pool + 1, 3), np.int64)  # the pool: (key, start, tokens, loss-bearing from)
        self.used = 0

    def add(self, key, tokens: int, loss_from: int = 0) -> Iterator[tuple]:
        """Pieces (key, start, length, sequence, offset) that are settled by one more item; loss-bearing tokens: those from loss_from."""
        start = 0
        full = int(min(self.limit[0], self.limit[2])) if loss_from < tokens else self.tokens
        if not self.cut and (tokens > self.tokens or tokens - loss_from > self.limit[2]):
            raise ValueError("an example exceeds a limit and must not be cut")
        while tokens - start >= full:
            yield key, start, full, self.sequence, 0
            self.sequence, start = self.sequence + 1, start + full
        if start < tokens:
            self._put(key, start, tokens, loss_from)
            if self.used >= self.most:
                while self.used > self.most // 2:
                    yield from self._fill()

    def _put(self, key, start: int, end: int, loss_from: int) -> None:
        self.need[self.used] = end - start, 1, max(0, end - max(start, loss_from))
        self.keys.append((key, start, end, loss_from))
        self.used += 1

    def _take(self, k: int):
        item, self.used = self.keys[k], self.used - 1
        self.keys[k], self.need[k] = self.keys[-1], self.need[self.used]
        self.keys.pop()
        return item

    def _fill(self, capacity: int | None = None) -> Iterator[tuple]:
        """One sequence from the pool."""
        free, at = self.limit.copy(), 0
        free[0] = capacity = capacity or self.tokens
        while self.used and free[0] > 0 and free[1] > 0:
            need = self.need[: self.used]
            fits = (need <= free).all(axis=1)
            score = np.where(fits, (need / self.limit) @ (free / self.limit), -1.0)
            k = int(score.argmax())
            # the last segment, or nothing that fits whole: fill up with a cut piece
            if self.cut and (not fits[k] or free[1] == 1 and need[k, 0] < free[0]):
                longest = int(need[:, 0].argmax())
                piece = min(int(free[0]), int(need[longest, 0]))
                _, start, end, loss_from = self.keys[longest]
                if loss_from < start + piece:  # keep the loss-bearing tokens within their limit
                    piece = min(piece, max(loss_from - start, 0) + int(free[2]))
                if piece <= 0:
                    break
                key, start, end, loss_from = self._take(longest)
                yield key, start, piece, self.sequence, at
                if start + piece < end:
                    self._put(key, start + piece, end, loss_from)
                free -= piece, 1, max(0, start + piece - max(start, loss_from))
                at += piece
            elif fits[k]:
                key, start, end, loss_from = self._take(k)
                yield key, start, end - start, self.sequence, at
                free -= end - start, 1, max(0, end - max(start, loss_from))
                at += end - start
            else:
                break
        self.sequence += 1

    def rest(self) -> Iterator[tuple]:
        """Pack what is left; the last tokens go to sequences whose lengths are powers of two."""
        while self.used:
            left = int(self.need[: self.used, 0].sum())
            yield from self._fill(None if left >= self.tokens or not self.cut else 1 << (left.bit_length() - 1))


def packed_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, tokens: int = 2048, segments: int | None = None, loss: int | None = None, keeps_space: bool = False, ids: bool = False, prompt: str | None = None) -> DataFrame:
    """documents -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (loss_tokens and ids if asked for).

    Texts are encoded whole with the tokenizer file named and end with end_id. A column named by ``prompt`` holds what
    stands before the text and bears no loss (instruction data): both are encoded, one after the other, and loss_tokens
    tells how many of a piece's tokens bear loss; without it all do. A null text or prompt is empty, so an empty row holds
    end_id alone. Repeated rows are packed each; of equally good examples the first in the pool is taken; an empty table
    gives no rows; other columns are ignored. The schema of ids is binary, unsigned 32-bit little-endian.
    """
    names = NAMES + ["loss_tokens"] * bool(prompt) + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tokens, segments, loss, first=TaskContext.get().partitionId() << 33)
        held: dict[int, list] = {}  # texts with pieces to come: doc_id, ids, tokens left, loss from
        tail = np.uint32(end_id).tobytes()

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(9)]
            for key, start, length, sequence, offset in pieces:
                item = held[key]
                part = memoryview(item[1])[4 * start : 4 * (start + length)]
                bears = start + length - min(start + length, max(start, item[3]))
                for c, x in zip(cols, (item[0], start, length, zlib.crc32(part), len(item[1]) // 4, sequence, offset, bears, bytes(part) if ids else None)):
                    c.append(x)
                item[2] -= length
                if not item[2]:
                    del held[key]
            kept = cols[:7] + cols[7:8] * bool(prompt) + cols[8:] * ids
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, kept)], names)

        n = 0
        for b in slices(batches, 4 << 20):
            pieces: list[tuple] = []
            encode = encoder(vocabulary, keeps_space).encode
            before = encode(as_bytes(b.column(2))) if prompt else [b""] * b.num_rows
            for doc_id, p, x in zip(b.column(0).to_pylist(), before, encode(as_bytes(b.column(1)))):
                x = p + x + tail
                held[n] = [doc_id, x, len(x) // 4, len(p) // 4]
                pieces += packer.add(n, len(x) // 4, len(p) // 4)
                n += 1
            yield out(pieces)
        yield out(list(packer.rest()))

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(prompt).alias("prompt")] if prompt else [])).mapInArrow(run, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def padding(pieces: DataFrame, tokens: int = 2048) -> DataFrame:
    """Sequences, their tokens, and the padding they need (to the limit, or none at a power of two)."""
    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return size.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(tokens - F.col("n"))).alias("padding"))
