"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative kept.

Vectors that are equal bit by bit are one class first. Cells are fitted on a bounded sample of classes, label by
label; every class has a home cell, the one of its nearest centroid. Two unit vectors on different sides of the
hyperplane between two centroids can only be within the angle t if both are within t of it, so each class also
visits the cells whose hyperplanes it is near to: a class meets all it can link with in its home cell, and no link is
lost. How many cells that spares depends on the vectors: those without any structure visit nearly all, and then the
work is that of all pairs of a label, in products of tiles. Cells are cut into tiles of bounded size, each vector goes
to a tile once, in single precision where that is exact, and what leaves a pair of tiles are link counts and stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import smallest_labels
from .common import again, map_rows, saved
from .components import components

#: Rows of a block product: of the side at home, and of the side that meets it.
TILE, GUESTS = 1500, 4096
#: Classes that one cell should have, about, and members of the sample that a cell needs.
CELL, SAMPLED = 2000, 10
#: Tile counts of up to so many cells are broadcast.
CELLS_AT_ONCE = 100_000


def usable(embedding: list | None) -> bool:
    """Is it a finite vector with a component that is not zero? Only such a one links."""
    if not embedding or None in embedding:
        return False
    x = np.asarray(embedding, dtype=float)
    return bool(np.isfinite(x).all() and x.any())


def vector_rows(batch: list[tuple]) -> Iterator[tuple]:
    """(vec_id, label, embedding) -> (vec_id, label, dim, key, raw): the components in as few bytes as hold them exactly, null if it links with nothing."""
    import hashlib

    for key, label, embedding in batch:
        if key is None or label is None or not usable(embedding):
            yield key, None, None, None, None
            continue
        x = np.asarray(embedding, dtype="<f8")
        with np.errstate(over="ignore"):
            short = x.astype("<f4")
        yield key, label, len(x), hashlib.md5(x.tobytes()).hexdigest(), (short if (short == x).all() else x).tobytes()


def units(raw, dim: int) -> np.ndarray:
    """Unit vectors in double precision as rows; each is stored in four or eight bytes a component."""
    x = np.array([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in raw], dtype=float).reshape(len(raw), dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k centroids of unit length; a cell that gets empty keeps its centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1))
        centres[norm > 1e-9] = sums[norm > 1e-9] / norm[norm > 1e-9, None]
    return np.unique(centres, axis=0)


def fit_cells(classes: DataFrame, sample: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of every (label, dim) that the sample shows to be large; others have one cell.

    At most `sample` classes, first by a hash, come to the driver.
    """
    counts = classes.count()
    got = classes.select("label", "dim", "raw").orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(sample).toPandas()
    out = {}
    for key, own in got.groupby(["label", "dim"]):
        k = min(len(own) // SAMPLED, round(counts * len(own) / len(got) / CELL))
        if k > 1:
            out[key] = spherical_kmeans(units(own["raw"].tolist(), key[1]), k, seed=seed)
    return out


def cell_rows(cells: dict[tuple[int, int], np.ndarray], cosine: float):
    sine = np.sqrt(1 - cosine * cosine) + 1e-9
    apart = {}
    for key, c in cells.items():
        apart[key] = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))

    def rows(batch: list[tuple]) -> Iterator[tuple]:
        """(rep, label, dim, n, raw) -> (..., cell, at_home): a row for its own cell and for each that it visits."""
        for rep, label, dim, n, raw in batch:
            centres = cells.get((label, dim))
            if centres is None:
                yield rep, label, dim, n, raw, 0, True
                continue
            dots = centres @ units([raw], dim)[0]
            own = int(dots.argmax())
            # the nearer centroids, each of which has a hyperplane to every other
            near = np.argsort(-dots, kind="stable")[:8]
            far = ((dots[near, None] - dots[None, :]) / apart[label, dim][near]).max(0) > sine
            far[own] = False
            for c in np.flatnonzero(~far):
                yield rep, label, dim, n, raw, int(c), int(c) == own

    return rows


def tile_links(cosine: float):
    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Home rows against candidates: how many vectors each home row links with, and a star for each connected part."""
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "head": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return none
        a, b, dim = left["rep"].to_numpy(), right["rep"].to_numpy(), int(left["dim"].iloc[0])
        hit = units(left["raw"].tolist(), dim) @ units(right["raw"].tolist(), dim).T >= cosine
        hit &= a[:, None] != b[None, :]
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return none
        hit = hit[np.ix_(rows, cols)]
        links = hit @ right["n"].to_numpy()[cols]
        top_a, top_b = smallest_labels(hit, a[rows], b[cols])
        return pd.DataFrame({"rep": np.concatenate([a[rows], b[cols]]), "links": np.concatenate([links, np.zeros(len(cols), np.int64)]), "head": np.concatenate([top_a, top_b])})

    return links


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Links are cosines of at least `cosine` in double precision between vectors of equal, non-null labels. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing and
    are a component of their own; vectors of different lengths do not link. A repeated row counts as a vector each
    time. kept marks the smallest id of each component; it is false where the id is null. Other columns are not
    read; an empty table gives an empty table.
    """
    base = map_rows(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")), "vec_id long, label long, dim int, key string, raw binary", vector_rows)
    base = saved(base, "vectors")
    key = ["label", "dim", "key"]
    classes = saved(base.where("raw is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw")), "classes")
    cells = fit_cells(classes, sample, seed)
    dealt = saved(map_rows(classes.select("rep", "label", "dim", "n", "raw"), "rep long, label long, dim int, n long, raw binary, cell int, home boolean", cell_rows(cells, cosine)), "cells")
    at = ["label", "dim", "cell"]
    tiles = dealt.groupBy(*at).agg(F.ceil(F.count_if("home") / TILE).alias("home_tiles"), F.ceil(F.count("*") / GUESTS).alias("all_tiles")).where("home_tiles > 0")
    tiles = saved(tiles, "tiles")
    few = tiles.count() <= CELLS_AT_ONCE
    sized = lambda df: df.join(F.broadcast(again(tiles)) if few else again(tiles), at)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    mine = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    left = sized(dealt.where("home")).select(*at, "rep", "raw", mine(F.col("home_tiles")).alias("i"), spread(F.col("all_tiles")).alias("j"))
    right = sized(again(dealt)).select(*at, "rep", "raw", "n", mine(F.col("all_tiles")).alias("j"), spread(F.col("home_tiles")).alias("i"))
    by = [*at, "i", "j"]
    found = saved(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(tile_links(cosine), "rep long, links long, head long"), "links")
    parts = components(found.select(F.col("head").alias("a"), F.col("rep").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return (
        base.drop("raw")
        .join(by_class, key, "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
