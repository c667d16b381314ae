"""Public tokenizers over units of text, whose results are remembered.

A unit is a stretch of text that the tokenizer splits off in any context, so that the ids of a
text are the ids of its units one after the other. Texts where that doesn't hold (a special
string inside, or a run of white space that a cut at a space would break) are encoded whole.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata

import numpy as np

#: A worker forgets its units beyond this many.
MOST_UNITS = 400_000
#: White space, a space, and white space or the end: no cut at such a space.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: ASCII punctuation less the apostrophe, which contractions begin with.
_MARKS = string.punctuation.replace("'", "")
#: Letters below this code point have been letters in every version of Unicode.
_LATIN_END = "\u0250"


def _byte_alphabet() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if it is printable."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_ALPHABET = _byte_alphabet()


def _spelled(text: str) -> str:
    return "".join([_ALPHABET[b] for b in text.encode()])


def _letters(text: str) -> bool:
    return text.isalpha() and max(text) < _LATIN_END


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Remembered(dict):
    def __init__(self, encode, prefix: str = "") -> None:
        self.encode, self.prefix = encode, prefix

    def __missing__(self, unit: str):
        if len(self) >= MOST_UNITS:
            self.clear()
        self[unit] = found = self.encode(self.prefix + unit)
        return found


class _Units:
    """Units of letters, with or without marks behind them, go to the tokenizer's model at once:
    the letters are one pre-token, and so are the marks. Others go the tokenizer's whole way."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class ByteCounts(_Units):
    """Token counts for a byte-level BPE whose words carry the space before them."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.first, self.later = _Remembered(self._unit), _Remembered(self._unit, " ")
        self.words = _Remembered(lambda word: len(self.model.tokenize(_spelled(word))))

    def _unit(self, text: str) -> int:
        word = text.rstrip(_MARKS)
        if not _letters(word.removeprefix(" ")):
            return self.whole(text)
        return self.words[word] + (self.words[text[len(word) :]] if len(word) < len(text) else 0)

    def whole(self, text: str) -> int:
        return len(self.encode(text))

    def count(self, text: str) -> int:
        if _RUN.search(text) or self.special(text):
            return self.whole(text)
        units = text.split(" ")
        return self.first[units[0]] + sum(map(self.later.__getitem__, units[1:]))


class WordIds(_Units):
    """Ids, as little-endian unsigned 32-bit bytes, for a BPE of lower-case words that drops white space."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.units = _Remembered(self._unit)
        self.words = _Remembered(lambda word: b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(_spelled(word))]))

    def _unit(self, text: str) -> bytes:
        core = text.rstrip(_MARKS)
        word = "".join([c.lower() for c in unicodedata.normalize("NFC", core)])
        if not word or not _letters(word):
            return self.whole(text)
        return self.words[word] + (self.words[text[len(core) :]] if len(core) < len(text) else b"")

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.special(text):
            return self.whole(text)
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))
