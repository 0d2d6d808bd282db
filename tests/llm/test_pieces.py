"""Encoding and decoding against the sentencepiece library: real texts, odd ones, hard ones."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallgrass.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(PATH)


def test_random_texts_and_ids(library):
    m, rng = pieces.Model(PATH), random.Random(5)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "   ", "\n", "\t", "é", "▁", "Ω", "中", "😀", "\x00", "\r", "1", "23", "<s>", "<0x41>", "�", "ß", ".", " the", "​", "í"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(rng.choice(m.piece[259:]) for _ in range(200)) for _ in range(200)]
    texts += [" " * n for n in range(70)] + ["x" + " " * n + "y" for n in range(70)] + ["a" * 3000, "", "▁" * 50]
    for t in texts:
        ids = m.encode(t).tolist()
        assert ids == library.encode(t), t
        assert m.decode(ids) == library.decode(ids), t
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3), 28705, 259]) for _ in range(rng.randint(0, 8))]
        assert m.decode(ids) == library.decode(ids), ids


def test_every_pair_of_tokens_agrees_with_merging():
    """The walk back through the merges says of two tokens what merging their text gives."""
    m, rng = pieces.Model(PATH), random.Random(6)
    known = sorted(m.split)
    for _ in range(20000):
        a, b = rng.choice(known), rng.choice(known)
        assert m._together(a, b) == (m._merged(m.piece[a] + m.piece[b])[1] == [m.piece[a], m.piece[b]])


def test_a_word_without_end_takes_linear_time():
    m = pieces.Model(PATH)
    assert m.decode(m.encode("ab" * 300_000).tolist()) == "ab" * 300_000


def test_query(spark, sf, library):
    rows = {r.doc_id: r for r in queries.op11_piece_codec(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_odd_rows(spark, docs, library):
    long = "word " * 20000 + "x" * 20000
    rows = [(None, "a b"), (None, None), (1, "same"), (1, "same"), (2, ""), (3, long)]
    d = docs(rows).withColumn("ids", F.lit(1)).withColumn("chunk", F.lit(2))
    got = pieces.decoded(pieces.encoded(d, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.text) for r in got) == sorted((str(i), library.encode(t or ""), t or "") for i, t in rows)
    assert pieces.decoded(pieces.encoded(docs([]), PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in pieces.decoded(nulls, PATH).collect()] == ["", ""]
