"""The tokens of `text.tokenize`, cut inside tasks from whole arrays of texts: as numbers, without a column of words."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa

from scrivia.functions.text import STOPWORDS, TOKEN

_TOKEN, _STOPWORDS = re.compile(TOKEN), frozenset(STOPWORDS)


def folded(word: str) -> str:
    """A word without its plural ending."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


class _Numbers(dict):
    """Words to the numbers of their tokens, in the order in which these come first; stop words to -1."""

    def __init__(self) -> None:
        self.of_token: dict[str, int] = {}
        self.tokens: list[str] = []

    def __missing__(self, word: str) -> int:
        n = -1
        if word not in _STOPWORDS:
            token = folded(word)
            if (n := self.of_token.setdefault(token, len(self.tokens))) == len(self.tokens):
                self.tokens.append(token)
        self[word] = n
        return n


class Vocabulary:
    """Tokens numbered as a task meets them; it starts anew where it would be larger than MOST words."""

    MOST = 500_000

    def __init__(self) -> None:
        self._start()

    def _start(self) -> None:
        self._numbers = _Numbers()
        self.tokens, self.encoded = self._numbers.tokens, []
        self.single, self.before, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, int)

    def coded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of all texts one behind another, and how many each text has (null: none). Numbers hold
        until the next call."""
        if len(self._numbers) > self.MOST:
            self._start()
        found = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        code = np.fromiter(map(self._numbers.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        kept = code >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
        return code[kept], np.diff(ends)

    def with_checksums(self) -> "Vocabulary":
        """encoded, lengths, and the CRC-32 of each token alone (single) and with the sign that joins it to a second one
        (before), for all tokens so far."""
        if new := [t.encode() for t in self.tokens[len(self.encoded) :]]:
            self.encoded += new
            for name, end in (("single", b""), ("before", b"_")):
                setattr(self, name, np.concatenate([getattr(self, name), np.array([zlib.crc32(w + end) for w in new], np.uint32)]))
            self.lengths = np.concatenate([self.lengths, np.array([len(w) for w in new], int)])
        return self

    def of(self, tokens: list[str]) -> "Vocabulary":
        """A vocabulary of these tokens, which are distinct and stay as they are."""
        self.tokens = self._numbers.tokens = tokens
        return self.with_checksums()


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The numbers, how many each text has, and the tokens by number, of texts alone."""
    vocabulary = Vocabulary()
    return *vocabulary.coded(texts), vocabulary.tokens


_BLANKS = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def alphanumeric_words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits."""
    return text.encode("ascii", "replace").translate(_BLANKS).split()


def lists_of(words: list[list[bytes]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(words)), pa.binary()).cast(pa.string()))
