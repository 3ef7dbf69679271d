"""Embedding near-dedup against brute force, with many small cells and tiles."""

import math

import numpy as np
import pytest

from fieldloom.llm import embedding_dedup
from fieldloom.llm.queries import QUERIES


def brute(rows, cosine=0.93):
    up = {i: i for i, _, _ in rows if i is not None}
    links = dict.fromkeys(up, 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    good = [(i, label, np.asarray(v, float)) for i, v, label in rows if i is not None and label is not None and embedding_dedup.usable(v)]
    for n, (i, label, x) in enumerate(good):
        for j, other, y in good[n + 1 :]:
            if label == other and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (links[i], find(i), find(i) == i) for i in up}


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("cell, tile, guests", [(2000, 1500, 4096), (20, 7, 11), (12, 30, 9)])
def test_all_links(spark, sf, monkeypatch, cell, tile, guests):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "SAMPLED", 3)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "GUESTS", guests)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert as_dict(QUERIES["op8_embedding_dedup"](spark, sf)) == brute(rows)


def test_clusters_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 15)
    monkeypatch.setattr(embedding_dedup, "SAMPLED", 3)
    monkeypatch.setattr(embedding_dedup, "TILE", 10)
    monkeypatch.setattr(embedding_dedup, "GUESTS", 16)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(260):
        v = rng.normal(size=6) if i < 60 else np.array(rows[rng.integers(0, 60)][1]) + rng.normal(scale=0.15, size=6)
        rows.append((i, v.tolist(), int(rng.integers(0, 2))))
    rows += [(300 + i, rows[5][1], 1) for i in range(30)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 6, 1), (403, [1.0, None], 1), (404, [1.0, float("nan")], 1), (405, [float("inf"), 1.0], 1), (406, rows[5][1], None), (None, rows[5][1], 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as cell", "2 as rep", "3 as n")
    got = as_dict(embedding_dedup.near_duplicates(df))
    assert got.pop(None) == (0, None, False)
    assert got == brute(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_extreme_components(spark):
    """Finite vectors link by their directions, also where squares of components over- or underflow."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1.7e308, 1.6e308]), (6, [5e-324, 5e-324]), (7, [1.0, -1.0]), (8, [1e300, 1e-300]), (9, [2.0, 0.0])]
    got = as_dict(embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")))
    assert got == {i: (5, 1, i == 1) for i in range(1, 7)} | {7: (0, 7, True), 8: (1, 8, True), 9: (1, 8, False)}
