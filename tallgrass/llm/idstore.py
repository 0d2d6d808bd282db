"""A content-addressed store of token ids.

Layout below one folder, all Parquet:

* ``chunks``: chunk (sha256 of its ids as stored), n (ids), ids (little-endian, ``width`` bytes each; null in a row
  that only adds references), refs (array of row, doc_id, seq: which document holds it as its seq-th chunk). Every
  distinct chunk has exactly one row with ids.
* ``recipes``: part, row, doc_id, n_tokens, chunks (hashes in order), root (Merkle root of the hashes); the parts
  and the rows in them are in ascending doc_id order.
* ``manifest``: part, documents, tokens, tokens_before, root (Merkle root of the part's document roots).

A document's id stream is cut where a rolling hash of its last ids meets a mask, so equal passages give equal chunks
wherever they stand. Copies within a task are merged before the shuffle, so a text with many copies moves once from
each task. Documents are never gathered to verify them: the checksum of a document follows from its chunks' checksums
(a CRC is linear), so one scan of the chunks and a join on hashes read everything back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.llm._common import as_bytes, rolled, slices
from tallgrass.llm.tokens import encoder

#: Ids looked at by the rolling hash; ids of a chunk: at least, on average beyond that, at most.
WINDOW, LEAST, MEAN, MOST = 8, 256, 1024, 8192
_POLY = 0xEDB88320


def cuts(ids: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST, window: int = WINDOW) -> list[int]:
    """Ends of the chunks of an id stream (content-defined; mean is a power of two)."""
    n, out, at = len(ids), [], 0
    if n > least + window:
        h = rolled(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15), window)
        for end in (np.nonzero(h & np.uint64(mean - 1) == 0)[0] + window).tolist():
            while end - at > most:
                at += most
                out.append(at)
            if end - at >= least and end < n:
                at = end
                out.append(at)
    while n - at > most:
        at += most
        out.append(at)
    return out + [n]


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree of sha256; an odd node moves up; one leaf is hashed too; no leaf: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out = np.zeros_like(a)
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to that of a text in which so many bytes follow: the text's CRC is the exclusive-or of all."""
    crc, bits, power = crc.astype(np.uint32), after.astype(np.uint64), np.array([0x00800000], np.uint32)  # x**8
    while bits.any():
        odd = (bits & np.uint64(1)).astype(bool)
        crc = np.where(odd, _times(crc, np.broadcast_to(power, crc.shape)), crc)
        power, bits = _times(power, power), bits >> np.uint64(1)
    return crc


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, keeps_space: bool = True, width: int = 2) -> None:
    """Encode whole texts (null: empty), append end_id, and write the store to a folder that all executors share.

    Rows with the same doc_id stay apart (row tells them); rows without a doc_id come first; an empty table gives an
    empty store; other columns are ignored.
    """
    kind = f"<u{width}"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, tail = TaskContext.get().partitionId() << 33, np.uint32(end_id).tobytes()
        seen: dict[bytes, list] = {}
        size = held = 0

        def out() -> pa.RecordBatch:
            refs = pa.array([[{"row": r, "doc_id": d, "seq": s} for r, d, s in x[2]] for x in seen.values()], pa.list_(REF))
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int32()), pa.array([x[1] for x in seen.values()], pa.binary()), refs], ["chunk", "n", "ids", "refs"])

        for b in slices(batches, 4 << 20):
            for doc_id, x in zip(b.column(0).to_pylist(), encoder(vocabulary, keeps_space).encode(as_bytes(b.column(1)))):
                ids, at = np.frombuffer(x + tail, "<u4"), 0
                if int(ids.max()) >> 8 * width:
                    raise ValueError("an id does not fit the width of the store")
                for seq, end in enumerate(cuts(ids)):
                    data = ids[at:end].astype(kind).tobytes()
                    key = hashlib.sha256(data).digest()
                    if key not in seen:
                        seen[key] = [end - at, data, []]
                        size += len(data)
                    seen[key][2].append((row, doc_id, seq))
                    held += 1
                    at = end
                row += 1
            if size > 32 << 20 or held > 200_000:
                yield out()
                seen, size, held = {}, 0, 0
        if seen:
            yield out()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a chunk meet in one task: the first keeps the ids."""
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for key in b.column(0).to_pylist():
                new.append(key not in seen)
                seen.add(key)
            ids = pa.compute.if_else(pa.array(new), b.column(2), pa.scalar(None, b.column(2).type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids, b.column(3)], ["chunk", "n", "ids", "refs"])

    schema = "chunk binary, n int, ids binary, refs array<struct<row: long, doc_id: long, seq: int>>"
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)
    # tasks as many as the input has, so that what each holds of the hashes does not grow with the data
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    raw.repartition(tasks, "chunk").mapInArrow(once, schema).write.option("compression", "zstd").parquet(f"{path}/chunks")

    spark = docs.sparkSession
    held = spark.read.parquet(f"{path}/chunks").select("chunk", "n", F.explode("refs").alias("r")).select("r.*", "chunk", "n")
    whole = held.groupBy("row", "doc_id").agg(F.sum("n").cast("long").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("c"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            roots = [merkle(c) for c in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int64()), *b.columns, pa.array(roots, pa.binary())], ["part", "row", "doc_id", "n_tokens", "chunks", "root"])

    ordered = whole.select("row", "doc_id", "n_tokens", F.col("c.chunk").alias("chunks")).repartitionByRange(F.col("doc_id"), F.col("row")).sortWithinPartitions("doc_id", "row")
    ordered.mapInArrow(rooted, "part long, row long, doc_id long, n_tokens long, chunks array<binary>, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _part_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


REF = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32())])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """row, doc_id, n_tokens, seq, chunk: the recipes chunk by chunk; stops at one whose chunks are not those, or not in the order, of its Merkle root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(3)
            for row, chunks, root in zip(b.column(0).to_pylist(), of.to_pylist(), b.column(4).to_pylist()):
                if merkle(chunks) != root:
                    raise ValueError(f"the recipe of row {row} is damaged")
            n = of.value_lengths().to_numpy(zero_copy_only=False)
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            seq = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(3)], pa.array(seq.astype(np.int32)), of.flatten()], ["row", "doc_id", "n_tokens", "seq", "chunk"])

    recipes = spark.read.parquet(f"{path}/recipes").select("row", "doc_id", "n_tokens", "chunks", "root")
    return recipes.mapInArrow(run, "row long, doc_id long, n_tokens long, seq int, chunk binary")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, documents, tokens, tokens_before, root, from the recipes: one row for each part."""

    def run(key, batch):
        batch = batch.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        return pa.table({"part": [key[0].as_py()], "documents": [batch.num_rows], "tokens": [pa.compute.sum(batch["n_tokens"]).as_py()], "root": pa.array([merkle(batch["root"].to_pylist())], pa.binary())})

    # a part is one task's share of the recipes, so a group is never larger than a partition
    of = recipes.select("part", "doc_id", "row", "n_tokens", "root").groupBy("part").applyInArrow(run, "part long, documents long, tokens long, root binary")
    # one row for each part: as many as tasks wrote the recipes
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return of.select("part", "documents", "tokens", F.coalesce(before, F.lit(0)).alias("tokens_before"), "root")



def _scanned(spark: SparkSession, path: str, width: int) -> DataFrame:
    """chunk, crc (of the ids as unsigned 32-bit integers), n: from the bytes stored; stops at a chunk whose hash is wrong."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, n = [], []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if hashlib.sha256(data).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(data, kind).astype("<u4").tobytes()))
                n.append(len(data) // width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], ["chunk", "crc", "n"])

    return spark.read.parquet(f"{path}/chunks").filter("ids is not null").select("chunk", "ids").mapInArrow(run, "chunk binary, crc long, n long")


def _checked(spark: SparkSession, path: str) -> None:
    """Compare the roots of all recipes with the manifest; a recipe's own chunks are compared with its root where they are read."""
    manifest = spark.read.parquet(f"{path}/manifest")
    again = _part_roots(spark.read.parquet(f"{path}/recipes"))
    wrong = manifest.join(again.select("part", F.col("root").alias("r"), F.col("tokens").alias("t"), F.col("documents").alias("d")), "part", "full").filter("not (root <=> r and tokens <=> t and documents <=> d)")
    if not wrong.isEmpty():
        raise ValueError("the recipes do not agree with the manifest")


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """row, doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Chunks are compared with their hashes, recipes with the Merkle roots worked out again from their chunks, the parts'
    roots with the manifest, and each recipe's length with its chunks; whatever differs is an error.
    """
    _checked(spark, path)
    manifest, recipes = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/recipes")
    entries = _recipes(spark, path).select("row", "seq", "chunk").join(_scanned(spark, path, width), "chunk")
    after = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = shifted(b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc.astype(np.int64)), b.column(2)], ["row", "crc", "n"])

    parts = entries.select("row", "crc", "n", F.coalesce(after, F.lit(0)).alias("after")).mapInArrow(run, "row long, crc long, n long")
    whole = parts.groupBy("row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("got"))
    here = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = recipes.select("row", "doc_id", "part", "n_tokens", F.coalesce(here, F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(manifest.select("part", "tokens_before")), "part")  # a row for each part
    n = F.when(F.col("got").eqNullSafe(F.col("n_tokens")), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe does not agree with its chunks")).cast("long"))
    return placed.join(whole, "row", "left").select("row", "doc_id", (F.col("tokens_before") + F.col("before")).alias("start"), n.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """row, doc_id, ids (binary, as stored): the documents put together again from their recipes, verified as in read_digests."""
    _checked(spark, path)
    entries = _recipes(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if hashlib.sha256(data).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
            yield b

    chunks = spark.read.parquet(f"{path}/chunks").filter("ids is not null").select("chunk", "ids").mapInArrow(run, "chunk binary, ids binary")
    # a chunk that is missing leaves a null, which the length shows
    got = entries.join(chunks, "chunk", "left").groupBy("row", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("c"))
    joined = F.unhex(F.array_join(F.transform("c.ids", lambda x: F.hex(x)), ""))
    whole = got.select("row", "doc_id", "n_tokens", joined.alias("ids"))
    right = F.octet_length("ids") == F.col("n_tokens") * width
    return whole.select("row", "doc_id", F.when(right, F.col("ids")).otherwise(F.raise_error(F.lit("a recipe does not agree with its chunks")).cast("binary")).alias("ids"))
