"""Byte-level BPE by corpus-level merge replay.

The words (matches of the split pattern) of a block of documents are gathered once each. An inverted index leads from
each token pair to the places where it stands in those words; the merges are replayed in rank order over the whole
block, and each touches only the places in its list and their neighbours. Documents are then read off the words.
Blocks are bounded, nothing is shuffled, and a worker keeps the words it has encoded, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_of
from .pretoken import splitter, through_words

#: Distinct words whose ids a worker keeps; beyond it, it starts afresh.
KEPT_WORDS = 800_000


#: Ids are below 2 ** SHIFT.
SHIFT = 20


class MergeReplay:
    """Encodes sets of byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.of_bytes = {(a, b): ranks.get(bytes([a, b])) for a in range(256) for b in range(256)}
        # every way to make a token of two: left id and right id in one integer -> the token's id, which is its rank
        self.merges = {ranks[t[:i]] << SHIFT | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word. All words lie in one array, chained by next and previous."""
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        single, rank = self.single, self.merges.get
        pairs = self.of_bytes
        index: dict[int, list[int]] = {}  # rank of a pair -> places of its left token
        for w in words:
            at, n = len(token), len(w)
            starts.append(at)
            token += [single[b] for b in w]
            after += range(at + 1, at + n + 1)
            before += range(at - 1, at + n - 1)
            if n:
                after[-1] = -1
                before[at] = -1
            i = at
            for pair in zip(w, w[1:]):
                if (r := pairs[pair]) is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                i += 1
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            places.sort()  # left to right within a word, as overlapping pairs are merged
            for i in places:
                a, j = token[i], after[i]
                if a < 0 or j < 0 or rank(a << SHIFT | token[j]) != r:
                    continue  # a merge has taken one of them
                token[i], token[j] = r, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (s := rank(r << SHIFT | token[k])) is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(heap, s)
                h = before[i]
                if h >= 0 and (s := rank(token[h] << SHIFT | r)) is not None:
                    if s in index:
                        index[s].append(h)
                    else:
                        index[s] = [h]
                        heapq.heappush(heap, s)
        out = []
        for at, w in zip(starts, words):
            ids, i = [], at if w else -1
            while i >= 0:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


@lru_cache(maxsize=2)
def replay(path: str) -> MergeReplay:
    """The ranks of a vocabulary file: on each line a base64 token and its rank."""
    with open(path, "rb") as f:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


@lru_cache(maxsize=2)
def kept_words(path: str) -> dict[str, bytes]:
    return {}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(data: bytes) -> list[int]:
    return memoryview(data).cast("I").tolist() if sys.byteorder == "little" else [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def encode_packed(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """The packed ids of whole texts, each match of the pattern encoded by itself."""
    merges = replay(path)
    return through_words(texts, splitter(pattern), kept_words(path), lambda new: map(packed, merges.encode([w.encode() for w in new])), KEPT_WORDS)


def encode_texts(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    return list(map(unpacked, encode_packed(texts, path, pattern)))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row; a null text is empty, an empty text has no ids.

    No row depends on another; repeated rows get equal rows. The vocabulary's path must exist on every machine.
    """

    def rows(batch: list[tuple]) -> Iterator[tuple]:
        for (key, _), ids in zip(batch, encode_texts([t for _, t in batch], path, pattern)):
            yield key, ids, replay(path).decode(ids)

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "doc_id long, ids array<int>, decoded binary", rows)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode_documents gives, as digests made where the ids are, so that long lists need not travel."""

    def rows(batch: list[tuple]) -> Iterator[tuple]:
        import hashlib

        for (key, _), data in zip(batch, encode_packed([t for _, t in batch], path, pattern)):
            yield key, len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(replay(path).decode(unpacked(data))).hexdigest()

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
