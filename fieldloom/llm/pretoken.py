"""Splitting texts by a tokenizer's pattern: the `regex` module for all texts, `re` for those of Latin letters alone.

For texts below LATIN_END the classes that only `regex` knows are written out, from `regex` itself, so both give equal
splits; `re` takes half the time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

LATIN_END = 0x250


def members(kind: str) -> str:
    """The code points below LATIN_END of a class such as \\p{L}, as ranges for a bracket of `re`."""
    import regex

    found = [c for c in range(LATIN_END) if regex.match(kind, chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\u{a:04x}" if a == b else f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def spelled_out(pattern: str) -> str:
    """The pattern with \\p{..} and \\s written out; \\S becomes what is not \\s."""
    out, inside, at = [], False, 0
    for m in re.finditer(r"\\p\{\w+\}|\\[sS]|\\.|[\[\]]", pattern):
        out.append(pattern[at : m.start()])
        at, token = m.end(), m[0]
        if token in "[]":
            inside = token == "["
        elif token == r"\S":
            token = f"[^{members(chr(92) + 's')}]"
        elif token == r"\s" or token.startswith(r"\p"):
            token = members(token) if inside else f"[{members(token)}]"
        out.append(token)
    return "".join([*out, pattern[at:]])


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    import regex

    every = regex.compile(pattern).findall
    latin = re.compile(spelled_out(pattern)).findall
    other = re.compile(f"[^\\x00-\\u{LATIN_END - 1:04x}]").search
    return lambda text: every(text) if other(text) else latin(text)


def through_words(texts: list[str], split: Callable[[str], list[str]], known: dict[str, bytes], encode: Callable[[list[str]], Iterable[bytes]], most: int) -> list[bytes]:
    """The ids of whole texts as packed bytes, joined from those of their words.

    Words that `known` lacks are encoded together, once, and kept; beyond `most` words it starts afresh, so its memory
    is bounded. Packed ids lie beside each other in memory, which joins them several times as fast as lists would.
    """
    if len(known) > most:
        known.clear()
    rows = []
    missing: dict[str, None] = {}
    for text in texts:
        words = split(text)
        parts = list(map(known.get, words))
        if None in parts:
            missing.update(dict.fromkeys(w for w, p in zip(words, parts) if p is None))
            rows.append((words, b""))
        else:
            rows.append((None, b"".join(parts)))
    new = list(missing)
    known.update(zip(new, encode(new)))
    return [joined if words is None else b"".join(map(known.__getitem__, words)) for words, joined in rows]
