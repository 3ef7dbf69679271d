"""One-to-one assignment: shortest augmenting paths in numpy over a score table of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from ..shipping import ship
from .components import components

#: Pairs of the largest problem that is taken; the algorithm needs the whole table in one task and cubic time.
MOST_PAIRS = 25_000_000


def solve(cost: np.ndarray) -> np.ndarray:
    """For each row the column of a least-cost assignment, -1 for rows that are left over when there are more rows."""
    n, m = cost.shape
    if n > m:
        back = solve(cost.T)
        out = np.full(n, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        dist, come, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, low, col = i, 0.0, -1
        while True:
            d = low + cost[row] - u[row] - v
            better = ~done & (d < dist - 1e-15)
            dist[better], come[better] = d[better], col
            col = int(np.where(done, np.inf, dist).argmin())
            low = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[i] += low
        inside = done.copy()
        inside[col] = False
        for j in np.flatnonzero(inside):
            u[row_of[j]] += low - dist[j]
            v[j] -= low - dist[j]
        while col >= 0:
            before = come[col]
            row_of[col] = i if before < 0 else row_of[before]
            col = before
    out = np.full(n, -1)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


def assign(scores: DataFrame, tau: float | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(src_pos, tgt_pos) of the assignment with the largest total score; -1 is unmatched.

    With tau every source may stay unmatched at that score, and a match below it is refused: then only pairs of at
    least tau matter, and each connected part of these is a problem of its own, so tables of any size are dealt over
    all tasks. A single problem goes to one task; its table is counted first, and one beyond most_pairs is an error.
    """
    ship(scores.sparkSession)
    if tau is None:
        parts = scores.select("src_pos", "tgt_pos", "score", F.lit(0).cast("long").alias("part"))
    else:
        fine = saved(scores.where(F.col("score") >= tau).select("src_pos", "tgt_pos", "score"), "assignable")
        # sources are even nodes, targets odd ones
        found = components(fine.select((F.col("src_pos") * 2).alias("a"), (F.col("tgt_pos") * 2 + 1).alias("b")))
        parts = fine.withColumn("node", F.col("src_pos") * 2).join(found.withColumnRenamed("component", "part"), "node").drop("node")
    sizes = parts.groupBy("part").agg(F.count_distinct("src_pos").alias("n"), F.count_distinct("tgt_pos").alias("m"))
    cells = F.col("n") * (F.col("m") + (F.col("n") if tau is not None else F.lit(0)))
    largest = sizes.agg(F.max(cells)).first()[0] or 0
    if largest > most_pairs:
        raise ValueError(f"{largest} pairs are more than one task can assign ({most_pairs}); block the catalogs first")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(pdf["src_pos"]), np.unique(pdf["tgt_pos"])
        s = np.full((len(rows), len(cols)), -1e9)
        s[np.searchsorted(rows, pdf["src_pos"]), np.searchsorted(cols, pdf["tgt_pos"])] = pdf["score"]
        wide = s if tau is None else np.concatenate([s, np.full((len(rows), len(rows)), float(tau))], 1)
        at = solve(-wide)
        fine = (at >= 0) & (at < len(cols))
        got = s[np.arange(len(rows)), np.where(fine, at, 0)]
        fine &= got > -1e9 if tau is None else got >= tau
        return pd.DataFrame({"src_pos": rows, "tgt_pos": np.where(fine, cols[np.where(fine, at, 0)], -1)})

    solved = parts.groupBy("part").applyInPandas(one, "src_pos long, tgt_pos long")
    if tau is None:
        return solved
    return scores.select("src_pos").distinct().join(solved, "src_pos", "left").select("src_pos", F.coalesce("tgt_pos", F.lit(-1).cast("long")).alias("tgt_pos"))


def assignment_accuracy(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """(accuracy of the matched, coverage) over the sources with a truth."""
    rows = assigned.join(truth.select("src_pos").distinct(), "src_pos", "left_semi").join(truth.withColumn("_hit", F.lit(1.0)), ["src_pos", "tgt_pos"], "left")
    matched = (F.col("tgt_pos") >= 0).cast("double")
    return rows.agg(
        F.round(F.when(F.sum(matched) > 0, F.sum(F.coalesce("_hit", F.lit(0.0))) / F.sum(matched)).otherwise(0.0), 6).alias("accuracy"),
        F.round(F.coalesce(F.avg(matched), F.lit(0.0)), 6).alias("coverage"),
    )
