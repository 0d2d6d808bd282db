"""Token ids by public tokenizers, encoded piece by piece: a piece met again costs a look-up.

Both tokenizers cut a text before they merge, and never across the end of a word, so a text's ids are its pieces' ids
in a row. The pieces here are: words at the six ASCII separators, where the tokenizer drops white space (word_bpe);
or a word with the one space before it, or a line feed, where it keeps white space (byte_bpe). Cuts beside white space
of two or more would not be safe there, so texts that have some are cut only before spaces that follow something else.
The strings of a tokenizer's special tokens give those tokens' ids wherever they stand in a text, as the library does.
New words of Latin letters go straight to the tokenizer's model, all other pieces through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

#: Pieces remembered by a worker, and how many of the first stay when the memory is full (frequent words come first).
MOST, STAY = 1_300_000, 1_000_000
_UNEVEN = re.compile(r"\s\s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
#: A word of Latin letters, with the space before it, and punctuation after it: the tokenizers cut it just there.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")
_open: dict[tuple[str, bool], Encoder] = {}


class _Known(dict):
    """Ids by piece; a piece that is not there is encoded."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece):
        out = self[piece] = self.learn(piece)
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.known, self.words, self.marks = keeps_space, _Known(self._piece), _Known(self._word), _Known(self._whole)
        self.after = _Known(lambda word: self._piece(" " + word))
        self.model, self.feed = self.tokenizer.model, self._whole("\n")

    def _even(self, text: str) -> bytes:
        """A text without white space of two or more: words after a space are looked up without it."""
        out, after, get = [], self.after.__getitem__, self.known.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out += (self.feed, get(first)) if first else (self.feed,)
            out += map(after, rest)
        return b"".join(out[1:])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text (null: of the empty text)."""
        get, out = self.known.__getitem__, []
        for t in texts:
            if not self.keeps_space:
                out.append(b"".join(map(get, (t or b"").split())))
            elif _UNEVEN.search(text := (t or b"").decode()):
                out.append(b"".join(map(get, _BEFORE_SPACE.split(text))))
            else:
                out.append(self._even(text))
            for known in (self.known, self.after, self.words):
                if len(known) > MOST:
                    first = dict(islice(known.items(), STAY))
                    known.clear()
                    known.update(first)
        return out

    def _piece(self, piece: str | bytes) -> bytes:
        text = piece if self.keeps_space else piece.decode()
        if not (plain := _PLAIN.fullmatch(text)):
            return self._whole(text)
        word, marks = plain.groups()
        if not marks:
            return self._word(word)
        return self.words[word] + self.marks[marks]

    def _word(self, word: str) -> bytes:
        if not self.keeps_space:
            word = word.lower()
        if word.isascii():
            mapped = word.replace(" ", "Ġ")
        else:
            mapped = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder for each worker process and file, kept between tasks."""
    if (path, keeps_space) not in _open:
        _open[path, keeps_space] = Encoder(path, keeps_space)
    return _open[path, keeps_space]
