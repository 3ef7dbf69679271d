"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of pieces.

A document's tokens are cut into full sequences from its start and one remainder. Pieces are dealt to groups at
random; within a group they are placed longest first, each into the first open bin that holds it. A tournament tree
over the bins' free room finds that bin in logarithmic time. Groups have a bounded expected size whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_per, saved, text_of


class Tournament:
    """Free room of bins in a binary tree; each node holds the most of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.most = [room] * (2 * self.leaves)

    def first_with(self, need: int) -> int:
        """The first bin with room for need; there is always one, as there are as many bins as pieces."""
        at, most = 1, self.most
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, used: int) -> None:
        at, most = bin_ + self.leaves, self.most
        most[at] -= used
        while at > 1:
            at //= 2
            top = max(most[2 * at], most[2 * at + 1])
            if most[at] == top:
                break
            most[at] = top


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each piece; longest first, ties in the order given."""
    tree = Tournament(len(lengths), room)
    used = [0] * len(lengths)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first_with(lengths[i])
        bins[i], offsets[i] = b, used[b]
        used[b] += lengths[i]
        tree.take(b, lengths[i])
    return bins, offsets


def tokenizer(path: str):
    """The `tokenizers` library's own reading of the file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, added_as_text: bool = False):
    """A function from a text to its ids as a uint32 array, equal to what tokenizer(path) gives.

    Where each merge makes a larger id than the one before, ids are ranks, and tiktoken encodes the same vocabulary
    several times as fast. Any other vocabulary is left to the `tokenizers` library. The string of an added token in a
    text is that token, as the library reads it by default (add_special_tokens=False only leaves out what a template
    adds); added_as_text makes it ordinary text, which the library calls encode_special_tokens.
    """
    import json
    import re

    import numpy as np

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, letters = model["model"]["vocab"], byte_of_letter()
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    plain = not any(t[flag] for t in model["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    plain = plain and not any(a != b and b.startswith(a) for a in special for b in special)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    single = [t for t in vocab if len(t) == 1 and t in letters]
    if plain and all(a < b for a, b in zip(made, made[1:])) and len(single) == 256 and len(vocab) == 256 + len(made) + len(special.keys() & vocab.keys()):
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        found = re.compile("|".join(map(re.escape, special))).search if special and not added_as_text else lambda text: None
        encode = lambda text: library.encode(text, allowed_special="all") if found(text) else library.encode_ordinary(text)
        return lambda text: np.asarray(encode(text), dtype="<u4")
    library = tokenizer(path)
    library.encode_special_tokens = added_as_text
    return lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(docs: DataFrame, path: str, pattern: str, room: int, end_id: int, id_col: str, text_col: str, with_ids: bool, added_as_text: bool) -> DataFrame:
    def rows(batch: list[tuple]) -> Iterator[tuple]:
        import numpy as np

        encode = encoder(path, pattern, added_as_text)
        for key, text in batch:
            ids = np.append(encode(text), np.uint32(end_id))
            for start in range(0, len(ids), room):
                piece = ids[start : start + room]
                yield (key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece.tolist()] if with_ids else ()))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), schema, rows)


def pack(docs: DataFrame, path: str, pattern: str, room: int = 2048, end_id: int = 1, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, added_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids], sequence_id, offset.

    Every document ends with end_id, so a null or empty text is one piece of one token. A null doc_id packs like any
    other. Repeated rows are packed each for itself. An empty table gives an empty table; only the two columns named
    are read. added_as_text is the encoder's. Sequences are padded to `room`, unless their length is a power of two.
    """
    import pandas as pd

    pieces = saved(cut(docs, path, pattern, room, end_id, id_col, text_col, with_ids, added_as_text).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    groups = rows_per(docs.sparkSession, pieces.count(), group_pieces)
    names = [c for c in pieces.columns if c != "deal"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "deal") + ", sequence_id long, offset long"

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "deal"], ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), room)
        out = pdf[names].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["sequence_id"] = pdf["group"].astype("int64") * (1 << 32) + pd.Series(bins, dtype="int64")
        out["offset"] = offsets
        return out

    return pieces.withColumn("group", F.pmod(F.col("deal"), F.lit(groups))).groupBy("group").applyInPandas(one_group, schema)
