"""Word-wise use of a tokenizers file whose pieces never span white space.

Encoding a text equals joining the encodings of its white-space separated words, as the file's
pre-tokeniser drops white space and no piece, special token or normal form reaches across it.
Each distinct word is encoded by the tokenizers library once and remembered, up to a bound.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import kept

#: Words that a worker remembers at most, some 150 bytes each; the memory is emptied when full.
REMEMBERED_WORDS = 400_000
#: Words longer than this are encoded but not remembered.
LONGEST_REMEMBERED = 64

_BEYOND_LATIN = re.compile("[^\u0000-ɏ]")
_END_MARKS = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Maps a word to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokens, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.plain = False
        if not self._splits():
            raise ValueError(f"{path}: its pieces reach across white space, so texts cannot be encoded word by word")
        self.plain = self._plain()

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        return kept(("words", path), lambda: cls(path))

    def _splits(self) -> bool:
        """Whether probes of several words, with all kinds of white space, encode as their words do, joined."""
        probes = ["The old man's dog, (12.5) x", "a  b\tc\nd\r\ne ", " éà ÇA  straße. 日本 語", "x\n\n\ny = [1, 2];"]
        return all(b"".join(map(self._whole, p.split())) == self._whole(p) for p in probes)

    def _plain(self) -> bool:
        """Whether a lower-case run of letters, and of end marks, is one byte-level piece, so that the model alone encodes it."""
        probes = ["qwertyzxv", "éàöñßøğ", "the", "straße"]
        return all(self._model(w + e) == self._whole(w + e) for w in probes for e in ("", ".", ",;", "?!.:"))

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokens(piece)]).tobytes()

    def _model(self, word: str) -> bytes:
        stem = word.rstrip(_END_MARKS)
        out = self._piece(stem) if stem else b""
        return out + self[word[len(stem) :]] if len(stem) < len(word) else out

    def __missing__(self, word: str) -> bytes:
        if self.plain and (stem := word.rstrip(_END_MARKS)).isalpha() and stem == stem.lower() and not _BEYOND_LATIN.search(word):
            out = self._model(word)
        else:
            out = self._whole(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = out
        return out

    def _words(self, text: str) -> list[str]:
        # "<|" may begin a special token, which is matched before lower-casing. Otherwise lower case is what the file's normaliser
        # makes; below U+0250 both agree, so it may come first and words meet more often.
        if "<|" not in text and not _BEYOND_LATIN.search(text):
            text = text.lower()
        # Not str.split(), which also splits where the file's pattern does not.
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        self[""] = b""
        return [b"".join(map(self.__getitem__, self._words(t))) for t in texts]


def chunks(items: list, size_of, most: int = 4_000_000):
    """Consecutive slices of items whose sizes sum to about `most`, one item at least."""
    at, total = 0, 0
    for i, x in enumerate(items):
        total += size_of(x)
        if total >= most:
            yield items[at : i + 1]
            at, total = i + 1, 0
    if at < len(items):
        yield items[at:]
