"""SentencePiece encoding and decoding of BPE models by a table of prefixes.

The encoding of a text's prefix ends in one token, whatever follows is merged later: so a table of the last token of each
prefix holds the whole encoding. An automaton over the vocabulary gives the tokens that end at a place; the one whose
predecessor, the last token of the prefix before it, is compatible with it (the two, encoded together, stay these two) is
the last token. Ids are recovered backwards from the end of the text. The work is linear in a text however long its words.

A text is cut where no token can lie across: before a space after something else, and around characters that no token
holds. Cuts met again cost a look-up.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm._common import slices

SPACE = "▁"
#: Cuts remembered by a worker, how many of the first stay when the memory is full, and the longest that is remembered.
MOST, STAY, LONGEST = 1_000_000, 700_000, 48
_open: dict[str, "Model"] = {}


class Model:
    """A SentencePiece model of type BPE: identity normaliser, byte fallback, a dummy space before the text or not."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as messages

        spec = messages.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or not spec.trainer_spec.byte_fallback or not spec.normalizer_spec.escape_whitespaces:
            raise ValueError("a BPE model with byte fallback that leaves texts unchanged is needed")
        kinds = [p.type for p in spec.pieces]
        if any(k in (4, 5) for k in kinds):
            raise ValueError("models with pieces defined by the user or unused are not known here")
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        self.piece, self.kind = [p.piece for p in spec.pieces], kinds
        self.score = [p.score for p in spec.pieces]
        self.id = {p: k for k, p in enumerate(self.piece) if kinds[k] == 1}
        self.marks = {k for k, kind in enumerate(kinds) if kind == 3}
        # what decode() writes for each id; bytes are joined before they are read as text
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode() for p, kind in zip(self.piece, kinds)]
        self.known: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.automaton = None

    def __getattr__(self, name: str):
        """How tokens are put together is learned when it is first asked for."""
        if name not in ("split", "direct", "byte", "long") or "automaton" not in self.__dict__:
            raise AttributeError(name)
        self._learn()
        return self.__dict__[name]

    def _learn(self) -> None:
        """What encoding needs beside the pieces: how each is put together, the automaton, where texts may be cut."""
        import ahocorasick

        kinds = self.kind
        self.byte = {int(self.piece[k][3:5], 16): k for k, kind in enumerate(kinds) if kind == 6}
        self.long = [len(p) for p in self.piece]
        ties = {s for s, n in Counter(self.score[k] for k in self.id.values() if self.long[k] > 1).items() if n > 1}
        # how each token is put together last; None: a character; the token itself is left out where merging never gives it
        self.split: dict[int, tuple[int, int] | None] = {}
        self.direct: set[int] = set()  # tokens of a tied score, or whose parts are merged later than they: pairs are merged to see
        for text, k in self.id.items():
            last, alone = self._merged(text)
            if len(alone) == 1:
                self.split[k] = last
                if last and (self.score[k] in ties or any(self.long[x] > 1 and self.score[x] <= self.score[k] for x in last)):
                    self.direct.add(k)
        automaton = ahocorasick.Automaton()
        for text, k in self.id.items():
            if k in self.split:
                automaton.add_word(text, k)
        automaton.make_automaton()
        beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE for a, b in beside):
            self.cut = None  # tokens may lie across the end of a word, so texts are not cut
        else:
            self.cut = re.compile(" *[^ ]+| +" if any("\n" in p for p in self.id) else " *[^ \n]+| +|\n")
        held = set("".join(self.id))
        self.bar = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in held)
        self.automaton = automaton

    def _merged(self, text: str) -> tuple[tuple[int, int] | None, list[str]]:
        """The last merge, and the symbols left, when the best pair (the leftmost of equal ones) is merged again and again."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap, last, at = [], None, self.id.get

        def look(i: int) -> None:
            j = after[i]
            if j < len(part) and (k := at(part[i] + part[j])) is not None:
                heap.append((-self.score[k], i, part[i], part[j]))

        for i in range(len(part) - 1):
            look(i)
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            if part[i] != a or after[i] >= len(part) or part[j := after[i]] != b:
                continue
            last, part[i], part[j], after[i] = (at(a, -1), at(b, -1)), a + b, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(part) and (new := at(part[k] + part[after[k]])) is not None:
                    heappush(heap, (-self.score[new], k, part[k], part[after[k]]))
        return last, [p for p in part if p]

    def _together(self, a: int, b: int) -> bool:
        """Whether tokens a and b, encoded together, stay a and b.

        Walks back through the merges within both, the latest first, and looks whether two parts that stood beside each
        other then would have been merged across the end of a before either was used up.
        """
        if a in self.direct or b in self.direct:
            return self._merged(self.piece[a] + self.piece[b])[1] == [self.piece[a], self.piece[b]]
        piece, score, split, of = self.piece, self.score, self.split, self.id.get
        ends_a = ends_b = -float("inf")  # the score of the merge that uses the part up
        while True:
            c = of(piece[a] + piece[b])
            if c is not None and score[c] > ends_a and score[c] >= ends_b:
                return False
            x, y = split.get(a), split.get(b)
            if x is None and y is None:
                return True
            # of one and the same merge on both sides, the left one came first
            if y is None or x is not None and score[a] < score[b]:
                ends_a, a = score[a], x[1]
            else:
                ends_b, b = score[b], y[0]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, a text whose spaces are escaped already; all of them are searched as one text, with a bar between that no token holds."""
        text = self.bar.join(parts)
        last = [-1] * (len(text) + 1)  # of each prefix: its last token; -1: none, as before the first character and after one without a token
        long, get, fit = self.long, self.fits.get, self._fit
        for e, k in self.automaton.iter(text):
            e += 1
            if last[e] < 0:
                a = last[e - long[k]]
                if a < 0 or (fit(a, k) if (fits := get(a << 20 | k)) is None else fits):
                    last[e] = k
        out, begin = [], 0
        for part in parts:
            ids, at = [], begin + len(part)
            while at > begin:
                k = last[at]
                if k >= 0:
                    ids.append(k)
                    at -= long[k]
                else:
                    ids += [self.byte[x] for x in reversed(text[at - 1].encode())]
                    at -= 1
            ids.reverse()
            out.append(array("i", ids).tobytes())
            begin += len(part) + 1
        return out

    def _learned(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of parts that are not known, which are known afterwards.

        Of a part that ends in a mark, the prefix table goes on from the part before the mark: where the mark fits what is
        last there, it is one more token.
        """
        whole, marked = [], []
        for part in parts:
            if not part[-1].isalnum() and part[-2:-1].isalnum() and part[-1] in self.id:
                marked.append(part)
                part = part[:-1]
                if part in self.known:
                    continue
            whole.append(part)
        whole = list(dict.fromkeys(whole))
        escaped = [p.replace(" ", SPACE) for p in whole]
        if any(self.bar in p for p in whole):
            new = {p: self._ids([e])[0] for p, e in zip(whole, escaped)}
        else:
            new = dict(zip(whole, self._ids(escaped)))
        for part in marked:
            ids = new.get(part[:-1]) or self.known[part[:-1]]
            mark = self.id[part[-1]]
            new[part] = ids + array("i", [mark]).tobytes() if self._fit(array("i", ids[-4:])[0], mark) else self._ids([part.replace(" ", SPACE)])[0]
        self.known.update((p, x) for p, x in new.items() if len(p) <= LONGEST)
        return new

    def _fit(self, a: int, b: int) -> bool:
        pair = a << 20 | b
        if (fit := self.fits.get(pair)) is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            # after a byte of a character without a token anything may follow
            fit = self.fits[pair] = self.kind[a] == 6 or self._together(a, b)
        return fit

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without those of its begin and end."""
        if not text:
            return np.zeros(0, "<i4")
        if self.automaton is None:
            self._learn()
        text = (" " if self.dummy else "") + text.replace(SPACE, " ")  # the mark of a space in a text is read as a space
        if self.cut is None:
            return np.frombuffer(self._ids([text.replace(" ", SPACE)])[0], "<i4")
        parts = self.cut.findall(text)
        found = list(map(self.known.get, parts))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            new = self._learned(list(dict.fromkeys(parts[i] for i in at)))
            for i in at:
                found[i] = new[parts[i]]
            if len(self.known) > MOST:
                self.known = dict(islice(self.known.items(), STAY))
        return np.frombuffer(b"".join(found), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, bytes read as UTF-8 (each that is none: the replacement character), without the dummy space."""
        if not self.marks.isdisjoint(ids):  # control marks write nothing, and bytes on both sides do not make one character
            runs, first = [], True
            for is_mark, run in groupby(ids, self.marks.__contains__):
                if not is_mark:
                    runs.append(self._text(list(run), first and self.dummy))
                    first = False
            return "".join(runs)
        return self._text(ids, self.dummy)

    def _text(self, ids: list[int], dummy: bool) -> str:
        if dummy and ids and self.kind[ids[0]] == 1 and self.piece[ids[0]].startswith(SPACE):
            return _read(self.bytes[ids[0]][1:] + b"".join(map(self.bytes.__getitem__, ids[1:])))
        return _read(b"".join(map(self.bytes.__getitem__, ids)))


def _read(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out = []
        while data:
            try:
                out.append(data.decode())
                break
            except UnicodeDecodeError as e:
                out += [data[: e.start].decode(), "�"]
                data = data[e.start + 1 :]
        return "".join(out)


def model(path: str) -> Model:
    """One model for each worker process and file, kept between tasks."""
    if path not in _open:
        _open[path] = Model(path)
    return _open[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each whole text; null and empty texts have no ids. One row for each row given, in one pass.

    Rows without a doc_id and repeated rows stay, each with its own ids; other columns are ignored; an empty table gives
    an empty one. Texts of any length are encoded whole, in linear time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            ids = [m.encode(t) if t else np.zeros(0, "<i4") for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: encoded() and then decoded(), in one pass through one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            ids = [m.encode(t) if t else np.zeros(0, "<i4") for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            texts = pa.array([m.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, np.concatenate(ids)), texts], ["doc_id", "ids", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of rows (doc_id, ids): what decode(ids) of the library gives; null or no ids: the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
