"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints are 64 bits in four blocks of 16. Two that differ in at most two bits agree in at least two blocks, so
they share one of six keys. A key that few fingerprints share is joined pair by pair and every pair is verified.
Within a key that many share, pairs would grow with the square: there each fingerprint emits itself and its 32
one-bit changes outside the two blocks, and all that emit the same value are within two bits of each other (two
fingerprints at distance two have a common neighbour at distance one), so a star to the smallest is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_rows, saved, text_of
from .components import components

SEED = 42
BLOCKS = [0xFFFF << s for s in (0, 16, 32, 48)]
#: Up to this many fingerprints, those that share a key are compared pair by pair; beyond it, by their neighbours.
PAIRWISE = 24


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_rows(words_per_shingle: int):
    """A row function (id, text) -> (id, fingerprint as signed long)."""

    def rows(batch: list[tuple]) -> Iterator[tuple]:
        import re

        import numpy as np
        import xxhash

        word = re.compile(r"[^\x20\x09-\x0D]+")
        lower = {c: c + 32 for c in range(65, 91)}
        digest, k = xxhash.xxh64_intdigest, words_per_shingle
        for key, text in batch:
            words = word.findall(text.translate(lower) if not text.isascii() else text.lower())
            if not words:
                yield key, 0
                continue
            shingles = map(" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [" ".join(words)]
            hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(hashes), 8192):
                bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            value = sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())
            yield key, signed(value)

    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp long) for every row. A text without words, or null, has the fingerprint zero."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), "id long, fp long", fingerprint_rows(words_per_shingle))


def close(a: Column, b: Column, distance: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) among nodes(node, fp), fp distinct, that connect exactly what pairs within two bits connect."""
    keys = [(i, BLOCKS[a] | BLOCKS[b]) for i, (a, b) in enumerate(combinations(range(4), 2))]
    keyed = nodes.select(
        "node",
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for i, m in keys])).alias("k"),
    ).select("node", "fp", "k.which", "k.block")
    counts = keyed.groupBy("which", "block").agg(F.count("*").alias("members")).where("members > 1")
    shared = saved(keyed.join(counts, ["which", "block"]), "blocks")
    few = shared.where(F.col("members") <= PAIRWISE).groupBy("which", "block").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("all"))
    # at most PAIRWISE members in each group; every pair is verified here
    pairs = (
        few.select(F.explode("all").alias("x"), "all")
        .select("x", F.explode(F.filter("all", lambda y: (y["node"] > F.col("x.node")) & close(y["fp"], F.col("x.fp")))).alias("y"))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    )
    masks = F.element_at(F.array(*[F.lit(signed(m)) for _, m in keys]), F.col("which") + 1)
    bits = F.array(*[F.lit(signed(1 << i)) for i in range(64)])
    flips = F.concat(F.array(F.col("fp")), F.transform(F.filter(bits, lambda b: b.bitwiseAND(masks) == 0), lambda b: F.col("fp").bitwiseXOR(b)))
    near = shared.where(F.col("members") > PAIRWISE).select("node", "fp", "which", F.explode(flips).alias("mid"))
    heads = near.groupBy("which", "mid").agg(F.min("node").alias("head"), F.min_by("fp", "node").alias("head_fp"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(heads, ["which", "mid"]).where(F.col("node") != F.col("head")).where(close(F.col("fp"), F.col("head_fp"))).select(F.col("head").alias("a"), F.col("node").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest id reachable by links, itself included. Rows with equal fingerprints are linked
    (repeated rows, empty and null texts too). Classes of equal fingerprints are the nodes, named by the fingerprint,
    so rows without an id link others as any row does; they are reported with a null id and their component, which is
    null only where no row of the component has an id. Rows that share an id keep each the component of its own
    fingerprint. Nothing depends on an order, so there are no ties. Columns other than the two named are not read; an
    empty table gives an empty table.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    # one row for each fingerprint, with its smallest id as a value: minima are made on the map side
    nodes = saved(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(F.col("fp").alias("node"), "fp", "least", "n"), "classes")
    found = components(links(nodes.select("node", "fp")))
    classes = nodes.join(found, "node", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(classes.join(least, "component").select("fp", "n", "component_id"), "named")
    return join_hot(prints, named, ["fp"], prints.count()).select(F.col("id").alias("doc_id"), "fp", "component_id")
