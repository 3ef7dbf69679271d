"""Pairs of source and target fields: all of them, those of distinct values, ground truth, splits."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: A target side of at most so many rows is broadcast; it is counted first. Beyond it both sides are joined in blocks.
BROADCAST_ROWS = 20_000


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a hint to broadcast it, if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def product(a: DataFrame, b: DataFrame, key_a: str, key_b: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of a with every row of b; no column name is in both.

    b is counted. Up to `limit` rows it is broadcast, and a is dealt by its key before the product: as many tasks as
    shuffles have, and what ranks or sums the rows of a key finds them together, so pairs are not shuffled. Beyond it
    both sides are dealt into blocks of about `limit` rows, and a task joins one block of each.
    """
    n = b.count()
    if n <= limit:
        parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return a.repartition(parts, key_a).crossJoin(F.broadcast(b))
    blocks_a, blocks_b = max(1, -(-a.count() // limit)), -(-n // limit)
    deal = lambda df, key, mine, its, other, count: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(its)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return deal(a, key_a, "_a", blocks_a, "_b", blocks_b).join(deal(b, key_b, "_b", blocks_b, "_a", blocks_a), ["_a", "_b"]).drop("_a", "_b")


def all_pairs(src: DataFrame, tgt: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every source with every target; columns are prefixed with src_ and tgt_."""
    return product(prefixed(src, "src_"), prefixed(tgt, "tgt_"), "src_pos", "tgt_pos", limit)


def by_distinct(pairs: DataFrame, src: DataFrame, tgt: DataFrame, key: str, score: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """pairs with the column `name`: a score of src_key and tgt_key that is worked out once for each two distinct values."""
    ship(pairs.sparkSession)
    a = src.select(F.col(key).alias("a")).distinct()
    b = tgt.select(F.col(key).alias("b")).distinct()
    table = product(a, b, "a", "b").withColumn(name, score(F.col("a"), F.col("b")))
    table = small(table, a.count() * b.count())
    return pairs.join(table, pairs[f"src_{key}"].eqNullSafe(table.a) & pairs[f"tgt_{key}"].eqNullSafe(table.b)).drop("a", "b")


def truth(pairs: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(src_pos, tgt_pos) of the pairs whose ids both catalogs have, each once."""
    s = src.select(F.col("field_id").alias("source"), F.col("pos").alias("src_pos"))
    t = tgt.select(F.col("field_id").alias("target"), F.col("pos").alias("tgt_pos"))
    return pairs.join(s, "source").join(t, "target").select("src_pos", "tgt_pos").distinct()


def truth_sets(truth_: DataFrame, src: DataFrame) -> DataFrame:
    """(src_pos, targets, first_target) for every source; no target gives an empty set and -1."""
    sets = truth_.groupBy("src_pos").agg(F.array_sort(F.collect_set("tgt_pos")).alias("targets"))
    out = src.select(F.col("pos").alias("src_pos")).join(sets, "src_pos", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<bigint>")))
    return out.withColumn("first_target", F.coalesce(F.array_min("targets"), F.lit(-1).cast("long")))


def split_by_source(pairs: DataFrame, ratio: float = 0.2, seed: int = 42, shuffled_like_python: bool = False) -> DataFrame:
    """pairs with `part`, 'eval' or 'calib': a share of the sources, at least one and not all, calibrates.

    By default sources are ordered by a hash of seed and id, which scales and which SQL can check.
    shuffled_like_python orders the sorted ids as random.Random(seed).shuffle does; the ids come to the driver.
    """
    spark = pairs.sparkSession
    ids = pairs.select("source").distinct()
    n = ids.count()
    take = min(max(1, int(n * ratio)), n - 1) if n > 1 else 0
    if shuffled_like_python:
        order = sorted(r.source for r in ids.collect())
        random.Random(seed).shuffle(order)
        calib = spark.createDataFrame([(i,) for i in order[:take]], "source string")
    else:
        calib = ids.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "source")), "source").limit(take)
    return pairs.join(calib.withColumn("_calib", F.lit(True)), "source", "left").withColumn("part", F.when(F.col("_calib"), "calib").otherwise("eval")).drop("_calib")


def dataset_stats(pairs: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """One row: sizes of both catalogs, pairs as given, and fan-out and fan-in of those that both catalogs have."""
    known = truth(pairs, src, tgt)
    out = known.groupBy("src_pos").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_sources_with_gt"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 4).alias("avg_targets_per_source"), F.coalesce(F.max("n"), F.lit(0)).alias("max_targets_per_source"))
    into = known.groupBy("tgt_pos").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_unique_targets_in_pairs"),
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 4).alias("avg_sources_per_target"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_sources_per_target"),
        F.count_if(F.col("n") > 1).alias("n_targets_with_multiple_sources"),
    )
    # each side is one row
    sizes = [src.agg(F.count("*").alias("n_source_fields")), tgt.agg(F.count("*").alias("n_target_fields")), pairs.agg(F.count("*").alias("n_gold_pairs")), out, into]
    row = sizes[0]
    for other in sizes[1:]:
        row = row.crossJoin(other)
    return row
