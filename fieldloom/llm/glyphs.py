"""Texts as arrays: code points, their classes, words and word hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points that are handled at once, unless one text alone has more.
CHARS_AT_ONCE = 400_000

#: Classes of code points.
SPACE, LETTER, CAPITAL, DIGIT, SYMBOL, SHOUT, STOP, OTHER = range(8)
CLASSES = 8
PLANE = 0x10000
STEM = 4


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first plane: the class, the lower-case code point, and 64 odd-looking bits of it."""
    kinds, lower = np.full(PLANE, OTHER, np.uint8), np.arange(PLANE, dtype=np.uint32)
    for c in range(PLANE):
        s = chr(c)
        if s.isalpha():
            kinds[c] = CAPITAL if s.isupper() else LETTER
            if len(s.lower()) == 1:
                lower[c] = ord(s.lower())
        elif s.isdigit():
            kinds[c] = DIGIT
    for s, kind in ((" \t\n\x0b\x0c\r", SPACE), ("#*$%&|<>", SYMBOL), ("!?", SHOUT), (".,;:'\"-()", STOP)):
        for x in s:
            kinds[ord(x)] = kind
    return kinds, lower, mix(lower.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def powers() -> np.ndarray:
    return mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


class Block:
    """Some whole texts in one array, a space between them.

    codes, kinds: of each code point; text_of_char; starts: first place of each word (a run without white space);
    text_of_word; hashes: of the words' letters, digits and the rest in lower case, without stops.
    """

    def __init__(self, texts: list[str]):
        kinds, lower, bits = tables()
        data = [np.frombuffer((t + " ").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        lengths = np.array([len(d) for d in data])
        self.n = len(texts)
        codes = np.concatenate(data)
        self.codes = np.where(codes < PLANE, codes, 0xFFFD)
        self.kinds = kinds[self.codes]
        self.text_of_char = np.repeat(np.arange(self.n), lengths)
        blank = self.kinds == SPACE
        first = ~blank
        first[1:] &= blank[:-1]
        first_of_text = np.cumsum(lengths) - lengths
        self.starts = np.flatnonzero(first)
        self.text_of_word = self.text_of_char[self.starts]
        self.first_of_text = first_of_text
        if len(self.starts):
            # places are counted in each word without its stops, so that "word," and "word" hash alike
            solid = (~blank & (self.kinds != STOP)).astype(np.int64)
            before = np.cumsum(solid) - solid
            word = np.cumsum(first) - 1
            at = before - before[self.starts][np.maximum(word, 0)]
            with np.errstate(over="ignore"):
                terms = np.where(solid.astype(bool), bits[self.codes] * powers()[np.clip(at, 0, 4095)], np.uint64(0))
                self.hashes = mix(np.add.reduceat(terms, self.starts))
                self.stems = mix(np.add.reduceat(np.where(at < STEM, terms, np.uint64(0)), self.starts) + np.uint64(1))
        else:
            self.hashes = self.stems = np.zeros(0, np.uint64)
        self.number = np.arange(len(self.starts)) - np.searchsorted(self.text_of_word, np.arange(self.n))[self.text_of_word]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to handle at once."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHARS_AT_ONCE:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def word_hash(word: str) -> int:
    return int(Block([word]).hashes[0])
