"""Token ids by the tokenizers library, with a cache of the words that a text splits into.

The library's pre-tokenizers track offsets for every word, which costs more than its merges. Texts
of plain Latin letters are therefore split here by the vocabulary's own pattern, and each new word
goes to the library's model once; all other texts go through the library whole. Both ways give the
same ids (tests compare them).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import tokenizers

#: Texts of these characters only are split here: for them Python's classes are those of the patterns.
PLAIN = re.compile("[\t-\r\x20-~ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿŒœ¿¡«»]*")
#: The split patterns of the two vocabularies, for texts of PLAIN characters.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
BYTE_LEVEL = re.compile(rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{LETTER}0-9\s]+|\s+(?!\S)|\s+")
WORD_END = re.compile(rf"[{LETTER}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^{LETTER}0-9\s]+")
#: Words that a worker remembers at least; at most twice as many.
CACHED = 400_000


def visible_bytes() -> dict[int, int]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones for
    themselves, the rest in order from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}


class Words(dict):
    """word -> its ids as bytes; a word that is not there goes through the model. Words that weren't met
    since the table was last full are forgotten."""

    def __init__(self, model, kind: str):
        self.tokenize, self.kind, self.table = model.tokenize, kind, visible_bytes()
        self.space, self.old = chr(self.table[32]), {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            seen = word.replace(" ", self.space) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.table)
            got = array(self.kind, [t.id for t in self.tokenize(seen)]).tobytes()
        self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str, pattern: re.Pattern):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split, self.lower = pattern.findall, pattern == WORD_END  # not `is`: workers get copies
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = Words(self.tokenizer.model, self.kind.char)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        if not text:
            return np.zeros(0, self.kind)
        if not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        self.words.trim()
        words = self.split(text.lower() if self.lower else text)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.kind)

    def encode_all(self, texts) -> Iterator[np.ndarray]:
        return (self.encode(t if isinstance(t, str) else None) for t in texts)


_open: dict[tuple[str, re.Pattern], Encoder] = {}


def encoder(path: str, pattern: re.Pattern) -> Encoder:
    """One for each worker process."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Encoder(path, pattern)
    return _open[path, pattern]
