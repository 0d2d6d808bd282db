"""Quality rules: base statistics of a text, and a linear-chain conditional random field over its lines.

The field has two labels, content (1) and boilerplate (0). A line's features (see FEATURES) score the label content;
a start score and a 2x2 table of transition scores link neighbouring lines. Viterbi decoding labels every line that
has a word; the share of the text's words in content lines decides whether the text is kept.

The field is trained on a bounded sample of labelled documents (``per_class`` documents of each quality, the first
``lines`` lines of each, for training only; both are parameters). A document's quality is its lines' first label;
then the lines of low-quality documents that the field itself finds to be content are relabelled, and it is trained
once more. Decoding and all statistics cover every line of every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import SPACE, as_bytes, rolled, slices

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
FEATURES = ("bias", "log words", "symbols", "upper case", "digits", "exclamation marks", "symbol words", "seen before", "repeated words", "ends a sentence", "under three words", "repeated windows")
#: Used where no labels are at hand: symbols, shouting, repeats and repeated lines speak for boilerplate.
PRIOR = (2.5, 0.5, -12.0, -8.0, -2.0, -20.0, -6.0, -1.5, -3.0, 0.5, -0.5, -4.0)


@dataclass(frozen=True)
class Field:
    """Scores of the label content by feature; of the first label; of a label (row) before another (column)."""

    weights: tuple[float, ...] = PRIOR
    start: tuple[float, float] = (0.0, 0.5)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.7, -0.7), (-0.7, 0.7))


def repeated(words: list[bytes], n: int = 5) -> np.ndarray:
    """Whether each word lies in a window of n words that is found twice or more in the text."""
    covered = np.zeros(len(words), bool)
    if len(words) > n:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        g = rolled(h, n)
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            edge = np.zeros(len(words) + 1, np.int64)
            edge[at] += 1
            edge[at + n] -= 1
            covered = np.cumsum(edge[:-1]) > 0
    return covered


def lines_of(text: bytes) -> tuple[list[tuple[bytes, int, bool]], list[bytes], np.ndarray]:
    """The lines with a word as (line, words, equal to an earlier line), the text's words, and their repeats."""
    words, seen, found = text.split(), set(), []
    for line in text.split(b"\n"):
        if n := len(line.split()):
            found.append((line, n, line in seen))
            seen.add(line)
    return found, words, repeated(words)


def line_features(found: list[tuple[bytes, int, bool]], words: list[bytes], again: np.ndarray) -> np.ndarray:
    out, at = np.zeros((len(found), len(FEATURES))), 0
    for k, (line, n, seen) in enumerate(found):
        size = len(line)
        own = words[at : at + n]
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, UPPER))
        lower = size - len(line.translate(None, LOWER))
        digits = size - len(line.translate(None, DIGITS))
        marks = line.count(b"!")
        bars = own.count(b"|") if symbols else 0
        end = line.rstrip()[-1:]
        out[k] = (1.0, math.log1p(n) / 5, symbols / size, upper / max(1, upper + lower), digits / size, marks / size, bars / n, seen, 1 - len(set(own)) / n, end in b".!?:" and end != b"", n < 3, again[at : at + n].sum() / n)
        at += n
    return out


def viterbi(scores: np.ndarray, field: Field) -> np.ndarray:
    """Best labels of a sequence of lines, given the scores of their label content (ties: content)."""
    (a, b), (c, d) = field.step
    zero, one, back = field.start[0], field.start[1], []
    for k, s in enumerate(scores.tolist()):
        if k:
            z, o = (zero + a, False) if zero + a > one + c else (one + c, True), (zero + b, False) if zero + b > one + d else (one + d, True)
            back.append((z[1], o[1]))
            zero, one = z[0], o[0]
        one += s
    out = np.zeros(len(scores), bool)
    if len(scores):
        now = one >= zero
        for k in range(len(scores) - 1, 0, -1):
            out[k] = now
            now = back[k - 1][now]
        out[0] = now
    return out


def fit(sequences: list[np.ndarray], quality: list[int], rounds: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """The field of greatest likelihood (ridge penalty), by Adam on exact gradients from forward-backward."""
    keep = [k for k, x in enumerate(sequences) if len(x)]
    if len({quality[k] for k in keep}) < 2:
        return Field()
    xs, q = [sequences[k] for k in keep], np.array([quality[k] for k in keep])
    n, t = len(xs), max(map(len, xs))
    x, on = np.zeros((n, t, len(FEATURES))), np.zeros((n, t), bool)
    for k, s in enumerate(xs):
        x[k, : len(s)], on[k, : len(s)] = s, True
    y = np.where(on, q[:, None], 0)
    # each document counts alike within its class, and both classes alike
    weight = np.where(q == 1, 0.5 / max(1, (q == 1).sum()), 0.5 / max(1, (q == 0).sum()))
    theta = np.concatenate([np.array(PRIOR), np.zeros(2), np.zeros(4)])
    f = len(FEATURES)

    def posteriors(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) by line, and expected transitions by document."""
        s, pi, a = x @ theta[:f], theta[f : f + 2], theta[f + 2 :].reshape(2, 2)
        u = np.stack([np.zeros_like(s), s], axis=2)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = u[:, 0] + pi
        for i in range(1, t):
            new = np.logaddexp(alpha[:, i - 1, None, 0] + a[0], alpha[:, i - 1, None, 1] + a[1]) + u[:, i]
            alpha[:, i] = np.where(on[:, i, None], new, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = np.logaddexp(a[:, 0] + (u[:, i + 1, 0] + beta[:, i + 1, 0])[:, None], a[:, 1] + (u[:, i + 1, 1] + beta[:, i + 1, 1])[:, None])
            beta[:, i] = np.where(on[:, i + 1, None], new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * on
        pair = alpha[:, :-1, :, None] + a + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]
        return one, pair.sum(axis=1)

    for again in (False, True):
        if again:  # lines of poor documents which look like content to the field are taken as such
            one, _ = posteriors(theta)
            y = np.where(on & (q == 0)[:, None] & (one > 0.9), 1, y)
        step = np.zeros((n, 2, 2))
        for i in range(1, t):
            np.add.at(step, (np.arange(n), y[:, i - 1], y[:, i]), on[:, i])
        first = np.stack([1 - y[:, 0], y[:, 0]], axis=1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            one, pair = posteriors(theta)
            length = weight / on.sum(axis=1)
            g = np.concatenate([((y - one) * on * length[:, None]).reshape(-1) @ x.reshape(-1, f), length @ (first - np.stack([1 - one[:, 0], one[:, 0]], axis=1)), (length[:, None, None] * (step - pair)).sum(axis=0).reshape(-1)]) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    a = theta[f + 2 :].reshape(2, 2)
    return Field(tuple(theta[:f].tolist()), tuple(theta[f : f + 2].tolist()), (tuple(a[0].tolist()), tuple(a[1].tolist())))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = 600, lines: int = 100) -> Field:
    """A field trained on at most per_class documents of each quality (those whose ids hash lowest)."""
    rated = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = [rated.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = some[0].unionAll(some[1])  # at most 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [line_features(*lines_of(t or b""))[:lines] for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.reshape(-1).tolist() for i in x], pa.list_(pa.float64()))], ["quality", "x"])

    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    rows = drawn.mapInArrow(run, "quality int, x array<double>").collect()
    return fit([np.array(r.x).reshape(-1, len(FEATURES)) for r in rows], [r.quality for r in rows])


def judge(text: str | None, field: Field, share: float = 0.5) -> tuple:
    """The columns of quality() behind doc_id."""
    text = text or ""
    raw = text.encode()
    found, words, again = lines_of(raw)
    n, repeats = len(words), int(again.sum())
    chars = len(text) - sum(text.count(c) for c in SPACE)
    failed = n < 10 or 100 * repeats > 20 * n
    good = viterbi(line_features(found, words, again) @ np.array(field.weights), field)
    part = sum(k for (_, k, _), g in zip(found, good) if g) / n if n else 0.0
    return n, chars, sum(raw.count(c) for c in SYMBOLS), sum(d for _, _, d in found), repeats, failed, not failed and part >= share, len(found), int(good.sum()), part


def kept(docs: DataFrame, field: Field, share: float = 0.5) -> DataFrame:
    """The documents that quality() keeps, all columns: one pass, nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([judge(t, field, share)[6] for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, field: Field, share: float = 0.5) -> DataFrame:
    """documents -> the base statistics, the content share, and kept.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines,
    content_share. A null or empty text has no words, so it fails. Repeated rows are judged alike; ties go to content.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
        for b in slices(batches):
            rows = list(zip(*(judge(t, field, share) for t in b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(rows, kinds)], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
