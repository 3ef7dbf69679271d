"""Near-duplicate texts: SimHash links, and links of texts whose sets of five-word shingles are alike.

Texts of equal fingerprints, or fingerprints at most two bits apart, are linked as in op10. Texts of similarity 0.8
differ in some ten of 64 bits, for which pigeonhole blocks of 64 bits would be three bits wide; so MinHash bands find
the other candidates: 16 bands of 4 minima, in which a pair of similarity 0.8 meets with a probability of 0.9998. A
candidate counts only if its exact sets of shingles are as alike as asked.

What is wanted are components, so only texts of different components are compared. In each band value that several
components share, every text meets the most central one first (whose other values most texts share); what that leaves
apart meets text by text, in few rows where it is little, else in blocked products of their sets. Texts themselves
are never shuffled, but for those that are compared, where these are too many to broadcast their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .blocks import components_of_hits, none_linked
from .common import again, join_hot, map_rows, saved, text_of
from .components import components

BANDS, MINIMA = 16, 4
#: A band value whose texts make up to so many pairs is compared in rows; beyond it, in blocked products.
PAIRS = 4096
#: Texts of one side of a blocked product and all their shingles, about, and shingles that it takes at once.
TILE, WEIGHT, COLUMNS = 1000, 1_000_000, 4096
#: Up to so many places of rows are broadcast, 24 bytes each.
PLACES = 200_000


def shingle_hashes(text: str, words_per_shingle: int):
    """One 64-bit hash for each shingle, with repeats; a shorter text is one shingle, a text without words has none."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ h[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketch_rows(words_per_shingle: int):
    """(id, file, at, key, text) -> (id, file, at, key, fp, band values)."""
    prints = simhash.fingerprint_rows(3)

    def rows(batch: list[tuple]) -> Iterator[tuple]:
        rng = np.random.default_rng(simhash.SEED)
        odd, flip = (rng.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        places = np.arange(1, BANDS + 1, dtype=np.uint64)
        for (_, fp), (*row, text) in zip(prints([(None, r[4]) for r in batch]), batch):
            h = shingle_hashes(text, words_per_shingle)
            bands: list[int] = []
            if len(h):
                low = np.full(BANDS * MINIMA, (1 << 64) - 1, dtype=np.uint64)
                for at in range(0, len(h), 512):
                    low = np.minimum(low, ((h[at : at + 512, None] ^ flip) * odd).min(axis=0))
                value = places.copy()
                for m in low.reshape(BANDS, MINIMA).T:
                    value = (value ^ m) * np.uint64(0x9E3779B97F4A7C15)
                    value ^= value >> np.uint64(31)
                bands = value.view(np.int64).tolist()
            yield *row, fp, bands

    return rows


def set_rows(words_per_shingle: int):
    """(t, text) -> (t, distinct shingle hashes, sorted)."""

    def rows(batch: list[tuple]) -> Iterator[tuple]:
        for t, text in batch:
            yield t, np.unique(shingle_hashes(text, words_per_shingle).view(np.int64))

    return rows


def with_places(docs: DataFrame) -> DataFrame:
    """(row, file, at): each row of docs as a struct, and what tells it from others, its place in storage.

    Rows that are not read from files as they are, or that have a column of that name, are written first.
    """
    stored = "_metadata" not in docs.columns and plain_scan(docs)
    if not stored:
        docs = saved(docs.select(F.struct("*").alias("row")), "documents")
    row = F.struct("*") if stored else F.col("row")
    return docs.select(row.alias("row"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def plain_scan(docs: DataFrame) -> bool:
    """Does docs read Parquet files row by row, so that no row comes twice from one place?"""
    lines = docs._jdf.queryExecution().analyzed().treeString().splitlines()
    nodes = {line.lstrip(" +-:").split(" ")[0] for line in lines}
    return nodes <= {"Relation", "Project", "Filter"} and any(line.rstrip().endswith("parquet") for line in lines)


def at_places(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """rows joined with places(file, at, ...), saved: broadcast only if they are counted and few."""
    return rows.join(F.broadcast(places) if places.count() <= PLACES else places, ["file", "at"], how)


def tile_links(similarity: float):
    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Stars over components that texts as alike as asked connect; all of one tile against all of another."""
        if not len(left) or not len(right):
            return none_linked()
        sets_a, sets_b = list(left["shingles"]), list(right["shingles"])
        of_b, col_b = np.unique(np.concatenate(sets_b), return_inverse=True)
        row_b = np.repeat(np.arange(len(sets_b)), [len(s) for s in sets_b])
        both = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
        flat, row_a = np.concatenate(sets_a), np.repeat(np.arange(len(sets_a)), [len(s) for s in sets_a])
        col_a = np.minimum(np.searchsorted(of_b, flat), len(of_b) - 1)
        known = of_b[col_a] == flat
        row_a, col_a = row_a[known], col_a[known]
        # shingles that both sides have, renumbered, some thousands at a time
        shared, col_a = np.unique(col_a, return_inverse=True)
        place = np.full(len(of_b), -1)
        place[shared] = np.arange(len(shared))
        col_b = place[col_b]
        for low in range(0, len(shared), COLUMNS):
            x, y = (np.zeros((len(s), COLUMNS), dtype=np.float32) for s in (sets_a, sets_b))
            for m, row, col in ((x, row_a, col_a), (y, row_b, col_b)):
                here = (col >= low) & (col < low + COLUMNS)
                m[row[here], col[here] - low] = 1
            both += x @ y.T
        na, nb = (np.array([len(s) for s in sets], dtype=float) for sets in (sets_a, sets_b))
        hit = both >= similarity * (na[:, None] + nb[None, :] - both) - 1e-9
        ca, cb = left["c"].to_numpy(), right["c"].to_numpy()
        return components_of_hits(hit & (ca[:, None] != cb[None, :]), ca, cb)

    return links


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The components (a, b) of pairs(x, cx, y, cy) of texts whose sets are as alike as asked."""
    side = lambda name: sets.select(F.col("t").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(side("y"), "y").join(side("x"), "x")
    nx, ny = F.size("of_x"), F.size("of_y")
    both = both.where(F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-9)
    common = F.size(F.array_intersect("of_x", "of_y"))
    return both.where(common >= similarity * (nx + ny - common) - 1e-9).select(F.col("cx").alias("a"), F.col("cy").alias("b"))


def contested(keyed: DataFrame) -> DataFrame:
    """Rows of keyed(band, t, c) whose band value several components share, with the number `members` of its texts."""
    values = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return keyed.join(values.select("band", F.col("n").alias("members")), "band")


def relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows(..., c) with c replaced by the component that merged(node, component) gives it."""
    return rows.join(merged, rows.c == merged.node, "left").withColumn("c", F.coalesce("component", "c")).drop("node", "component")


def apart(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links between all texts of different components that share a band value in rest(band, t, c, head, ch).

    The head has met all; a link needs a text that is not of the head's component, so these are one side.
    """
    out = F.col("c") != F.col("ch")
    sizes = rest.join(sets.select("t", F.size("shingles").alias("w")), "t").groupBy("band").agg(F.count("*").alias("n"), F.count_if(out).alias("m"), F.sum("w").alias("w"), F.sum(F.when(out, F.col("w"))).alias("v"))
    tiles = lambda n, weight: F.ceil(F.greatest(F.col(n) / TILE, F.col(weight) / WEIGHT)).alias(f"{n}_tiles")
    rest = saved(rest.join(sizes.where("m > 0").select("band", "n", "m", tiles("n", "w"), tiles("m", "v")), "band"), "apart")
    few, many = F.col("n") * F.col("m") <= PAIRS, F.col("n") * F.col("m") > PAIRS
    one = rest.where(few).where(out).select("band", F.col("t").alias("x"), F.col("c").alias("cx"))
    other = again(rest).where(few).where("t <> head").select("band", F.col("t").alias("y"), F.col("c").alias("cy"), out.alias("also"))
    pairs = one.join(other, "band").where("cx <> cy and (not also or x < y)").select("x", "cx", "y", "cy").distinct()
    found = verified(pairs, sets, similarity)
    if rest.where(many).isEmpty():
        return found
    spread = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    mine = lambda n: F.pmod(F.xxhash64("t"), n).cast("int")
    rows, cols = F.col("m_tiles"), F.col("n_tiles")
    left = rest.where(many).where(out).join(sets, "t").select("band", "c", "shingles", mine(rows).alias("i"), spread(cols).alias("j"))
    right = again(rest).where(many).join(again(sets), "t").select("band", "c", "shingles", mine(cols).alias("j"), spread(rows).alias("i"))
    by = ["band", "i", "j"]
    return found.union(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(tile_links(similarity), "a long, b long"))


def alike(rows: DataFrame, texts: DataFrame, similarity: float, words_per_shingle: int, text: Column) -> DataFrame:
    """(node, component) over the components c of texts(t, best, bands, c) that verified links connect."""
    shared = saved(contested(texts.select("t", "c", F.explode("bands").alias("band"))), "shared")
    wanted = shared.select("t").distinct().join(texts.select("t", F.col("best.file").alias("file"), F.col("best.at").alias("at")), "t")
    sets = saved(map_rows(at_places(rows, saved(wanted, "wanted"), "inner").select("t", text.alias("text")), "t long, shingles array<long>", set_rows(words_per_shingle)), "sets")
    central = shared.groupBy("t").agg(F.sum("members").alias("score"))
    heads = shared.join(central, "t").groupBy("band").agg(F.max_by(F.struct("t", "c"), F.struct("score", -F.col("t"))).alias("h"))
    led = saved(shared.join(heads.select("band", F.col("h.t").alias("head"), F.col("h.c").alias("ch")), "band"), "led")
    star = led.where("c <> ch").select(F.col("head").alias("x"), F.col("ch").alias("cx"), F.col("t").alias("y"), F.col("c").alias("cy")).distinct()
    first = saved(verified(star, sets, similarity), "links")
    merged = components(first)
    now = merged.select(F.col("node").alias("n2"), F.col("component").alias("m2"))
    rest = relabelled(led, merged).join(now, F.col("ch") == now.n2, "left").withColumn("ch", F.coalesce("m2", "ch")).select("band", "t", "c", "head", "ch")
    second = saved(apart(rest, sets, similarity), "links")
    if second.isEmpty():
        return merged
    # the second round links components of the first
    return components(second.union(merged.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def one_of_each(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of linked texts: a row with the smallest id, a null id only where no other is.

    Rows are told by their place in storage, so of rows that share an id only those stay that are chosen for their own
    group; of equal rows, or rows with the same id, the first by place stays. Null and empty texts, and texts without
    words, are one group. Any column passes through as it is, whatever its name. An empty table gives an empty table.
    """
    rows = with_places(docs)
    text = text_of(f"row.`{text_col}`")
    source = rows.select(F.col(f"row.`{id_col}`").cast("long").alias("id"), "file", "at", F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    sketch = saved(map_rows(source, "id long, file long, at long, key string, fp long, bands array<long>", sketch_rows(words_per_shingle)), "sketches")
    # a fingerprint is a node and names itself
    linked = components(simhash.links(sketch.select(F.col("fp").alias("node"), "fp").distinct()))
    texts = sketch.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "at")).alias("best"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    texts = texts.join(linked, texts.fp == linked.node, "left").select(F.monotonically_increasing_id().alias("t"), "key", "n", "best", "bands", F.coalesce("component", "fp").alias("c"))
    texts = saved(texts, "texts")
    groups = relabelled(texts.select("key", "n", "best", "c"), alike(rows, texts, similarity, words_per_shingle, text))
    chosen = groups.groupBy("c").agg(F.min("best").alias("chosen"))
    stays = saved(groups.join(chosen, "c").select("key", "n", "chosen"), "stays")
    # of a group the chosen place stays, all others go; these are the few
    gone = join_hot(sketch.select("key", "file", "at"), stays, ["key"], sketch.count()).where((F.col("file") != F.col("chosen.file")) | (F.col("at") != F.col("chosen.at"))).select("file", "at")
    return at_places(rows, saved(gone, "gone"), "left_anti").select("row.*")
