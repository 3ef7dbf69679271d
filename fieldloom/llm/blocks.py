"""Blocked products of two tiles: what leaves them are stars over connected parts, not pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd


def none_linked() -> pd.DataFrame:
    return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})


def smallest_labels(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of hit the smallest of the labels a (of rows) and b (of columns) that hits connect it with."""
    top_a, top_b, far = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(top_b, np.where(hit, top_a[:, None], far).min(0))
        new_a = np.minimum(top_a, np.where(hit, new_b[None, :], far).min(1))
        if (new_a == top_a).all() and (new_b == top_b).all():
            return top_a, top_b
        top_a, top_b = new_a, new_b


def components_of_hits(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """(a, b) edges of stars that connect what the hits connect; a label of its own star is left out."""
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return none_linked()
    top_a, top_b = smallest_labels(hit[np.ix_(rows, cols)], a[rows], b[cols])
    edges = np.unique(np.stack([np.concatenate([top_a, top_b]), np.concatenate([a[rows], b[cols]])], 1), axis=0)
    edges = edges[edges[:, 0] != edges[:, 1]]
    return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})
