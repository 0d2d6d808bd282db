"""What several corpus operators share: shared-folder tables, words, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() without arguments splits at exactly these six.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). One is made only for a local session that names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallgrass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a written() table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Buckets by which rows without a match are left out before a shuffle.
SIEVE = 1 << 20


def sifted(df: DataFrame, key: Column, wanted: DataFrame, of: Column) -> DataFrame:
    """df without rows whose key (a hash) cannot be in wanted, as far as SIEVE buckets tell: fewer rows to shuffle for a join that follows.

    The table that is broadcast has no more rows than there are buckets, however large wanted is.
    """
    some = wanted.select(of.bitwiseAND(SIEVE - 1).alias("bucket_")).distinct()
    return df.join(F.broadcast(some), key.bitwiseAND(SIEVE - 1) == F.col("bucket_"), "left_semi")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that the arrays made from one stay small however long the texts are."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * min(1.0, max_bytes / max(1, batch.nbytes))))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of which every bit depends on every bit of the numbers given."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ h >> np.uint64(33)


_GAP = np.zeros(256, bool)
_GAP[list(SPACE.encode())] = True
_BASE = 0xD1342543DE82EF95
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """The first n powers of the base (or of its inverse), modulo 2**64."""
    if len(_powers[sign]) < n:
        all_ = np.full(1 << (n - 1).bit_length(), pow(_BASE, sign, 1 << 64), np.uint64)
        all_[0] = 1
        _powers[sign] = np.cumprod(all_, dtype=np.uint64)
    return _powers[sign][:n]


def tokens(text: bytes, part: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a text and their 64-bit hashes, for all words at once.

    A word's hash is a polynomial in its bytes, taken from running sums over the text; it is worked out in parts of about
    so many bytes, cut between words.
    """
    data, at, places, hashes = np.frombuffer(text, np.uint8), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while at < len(data):
        end = min(len(data), at + part)
        if end < len(data):
            gaps = np.flatnonzero(_GAP[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word of more than a part
                gaps = np.flatnonzero(_GAP[data[end:]])
                end = end + int(gaps[0]) + 1 if len(gaps) else len(data)
        own = data[at:end]
        low = np.flatnonzero(own <= 32)  # few bytes besides the gaps
        gaps = np.concatenate([[-1], low[_GAP[own[low]]], [len(own)]])
        long = np.flatnonzero(gaps[1:] - gaps[:-1] > 1)
        first, last = gaps[long] + 1, gaps[long + 1]
        with np.errstate(over="ignore"):
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own.astype(np.uint64) * _power(1, len(own)), out=total[1:])
            hashes.append(mixed((total[last] - total[first]) * _power(-1, len(own))[first] + (last - first).astype(np.uint64)))
        places.append(first + at)
        at = end
    return np.concatenate(places), np.concatenate(hashes)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int, mult: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes (wrapping polynomial), by doubling the number of words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, held = h, 1  # out: the polynomials of `held` words each
    with np.errstate(over="ignore"):
        for bit in bin(n)[3:]:
            new = out[:-held] * np.uint64(pow(mult, held, 1 << 64))
            new += out[held:]
            out, held = new, 2 * held
            if bit == "1":
                out = out[:-1] * np.uint64(mult)
                out += h[held : held + len(out)]
                held += 1
        out = out ^ (out >> np.uint64(31))
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def words_of(text: Column) -> Column:
    """The words of a text as an array (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
