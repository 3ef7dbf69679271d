"""Connected components of an edge table, by minimum labels and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, saved

#: Pointers are written after so many doublings; those between are cached and made again if an executor is lost.
WRITTEN_EVERY = 3


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), both long; component is the smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are doubled until all reach a root, and the
    edges are contracted to roots. Minima are summed on the map side, so a node with very many edges is no hot key.
    Nodes without an edge have no row. Null ends are left out.
    """
    left = saved(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    mapping = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")).persist()
        turn, moved = 0, 1
        while moved:
            turn += 1
            top = up.select(F.col("node").alias("n2"), F.col("up").alias("u2"))
            step = up.join(top, up.up == top.n2).select("node", F.col("u2").alias("up"), (F.col("u2") != F.col("up")).alias("moved"))
            step = saved(step, "up") if turn % WRITTEN_EVERY == 0 else step.persist()
            moved = step.where("moved").count()
            drop(up)
            up = step
        roots = up.select(F.col("node").alias("n2"), F.col("up").alias("u2"))
        if mapping is None:
            mapping_now = saved(up.select("node", F.col("up").alias("component")), "map")
        else:
            mapping_now = saved(mapping.join(roots, mapping.component == roots.n2, "left").select("node", F.coalesce("u2", "component").alias("component")), "map")
            forget(mapping)
        mapping = mapping_now
        at_a = left.join(roots, left.a == roots.n2).select(F.col("u2").alias("a"), "b")
        roots_b = up.select(F.col("node").alias("n3"), F.col("up").alias("u3"))
        at_b = at_a.join(roots_b, at_a.b == roots_b.n3).select("a", F.col("u3").alias("b"))
        now = saved(at_b.where("a <> b").distinct(), "edges")
        forget(left)
        drop(up)
        left = now
    else:
        raise RuntimeError(f"edges remain after {max_rounds} rounds")
    forget(left)
    if mapping is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return mapping


def drop(df: DataFrame) -> None:
    if hasattr(df, "saved_path"):
        forget(df)
    else:
        df.unpersist()
