"""Ranks, metrics and probabilities over scores(src_pos, tgt_pos, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def row() -> WindowSpec:
    """All targets of a source."""
    return Window.partitionBy("src_pos")


def best_first() -> WindowSpec:
    """Ties go to the smaller target position."""
    return row().orderBy(F.desc("score"), "tgt_pos")


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(best_first()))


def top_k(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best targets of each source; Catalyst keeps k rows of each before the shuffle."""
    return ranked(scores).where(F.col("rank") <= k)


def with_truth(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of the sources that have a truth, with `relevant`. Targets are never left out.

    A source's true targets are one array, which meets its scores by the source: where scores lie together by source,
    as the product of all_pairs() does, they are not shuffled.
    """
    sets = truth.groupBy("src_pos").agg(F.collect_set("tgt_pos").alias("_targets"))
    return scores.join(sets.hint("shuffle_hash"), "src_pos").withColumn("relevant", F.array_contains("_targets", F.col("tgt_pos"))).drop("_targets")


def best_ranks(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(src_pos, rank): the best rank of a true target."""
    return per_source(scores, truth, ()).select("src_pos", "rank")


def gain_at(k: int, n: Column) -> Column:
    """The largest gain with n relevant targets, cut at k; n is at least 1."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), n.cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def per_source(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """For every source with a truth: its best rank and its NDCG at each k."""
    return per_source_of(scores, truth, ["score"], ks).drop("setting")


def per_source_of(scores: DataFrame, truth: DataFrame, columns: list[str], ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """per_source() of several score columns at once: a row for each source and column, named in `setting`.

    Nothing is sorted: the best true targets of each source are gathered, and one pass counts the targets that beat
    each of them, which is its rank. Ties go to the smaller position.
    """
    most = max((1, *ks))
    relevant = with_truth(scores, truth).where("relevant")
    gathered = relevant.groupBy("src_pos").agg(F.count("*").alias("n"), *[F.slice(F.sort_array(F.collect_list(F.struct(F.col(c).alias("s"), (-F.col("tgt_pos")).alias("t"))), False), 1, most).alias(f"_best{i}") for i, c in enumerate(columns)])
    best = gathered.select("src_pos", "n", *[F.get(f"_best{i}", F.lit(k))[part].alias(f"_{part}{i}_{k}") for i in range(len(columns)) for k in range(most) for part in ("s", "t")], *[F.array_min(f"_best{i}.s").alias(f"_floor{i}") for i in range(len(columns))])
    # few targets reach the least of a source's best true ones, which they must to beat any; a plain comparison would also
    # become a test for null, for which the product would work scores out once more
    reach = F.coalesce(reduce(lambda a, b: a | b, [F.col(c) >= F.col(f"_floor{i}") for i, c in enumerate(columns)]), F.lit(False))

    def beats(i: int, k: int) -> Column:
        s, t = F.col(f"_s{i}_{k}"), F.col(f"_t{i}_{k}")
        return (F.col(columns[i]) > s) | (F.col(columns[i]) == s) & (-F.col("tgt_pos") > t)

    # a rank is null where there are fewer true targets
    counts = [F.sum(F.when(beats(i, k), 1).when(F.col(f"_t{i}_{k}").isNotNull(), 0)).alias(f"_r{i}_{k}") for i in range(len(columns)) for k in range(most)]
    ranks = scores.join(best.hint("shuffle_hash"), "src_pos").where(reach).groupBy("src_pos").agg(F.first("n").alias("n"), *counts)

    def row_of(i: int) -> Column:
        gains = [sum((F.when(F.col(f"_r{i}_{j}") < k, 1 / F.log2(F.col(f"_r{i}_{j}") + 2.0)).otherwise(0.0) for j in range(k)), F.lit(0.0)) / gain_at(k, F.col("n")) for k in ks]
        return F.struct(F.lit(columns[i]).alias("setting"), (F.col(f"_r{i}_0") + 1).alias("rank"), *[g.alias(f"ndcg{k}") for k, g in zip(ks, gains)])

    return ranks.select("src_pos", F.explode(F.array(*map(row_of, range(len(columns))))).alias("x")).select("src_pos", "x.*")


def hit(k: int) -> Column:
    return F.avg((F.col("rank") <= k).cast("double"))


def metrics(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: Hit@1/3/5, MRR, NDCG@3/5 over the sources with a truth, and their number."""
    return summary(per_source(scores, truth))


def summary(rows: DataFrame, by: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n_eval"), *[F.round(hit(k), 6).alias(f"hit_at_{k}") for k in (1, 3, 5)], F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.round(F.avg("ndcg3"), 6).alias("ndcg_at_3"), F.round(F.avg("ndcg5"), 6).alias("ndcg_at_5")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def top1_margin(scores: DataFrame) -> DataFrame:
    """The mean of best minus second score; sources with one target count for nothing."""
    two = top_k(scores, 2).groupBy("src_pos").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))
    return two.agg(F.round(F.avg("margin"), 6).alias("top1_margin"))


def candidate_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("src_pos").agg(F.count("*").alias("n")).agg(F.avg("n").alias("avg_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"))


def softmax(scores: DataFrame, tau: float = 1.0) -> DataFrame:
    """scores with `prob`: a stable softmax of score / tau over each source's targets."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    e = F.exp((F.col("score") - F.max("score").over(row())) / tau)
    return scores.withColumn("_e", e).withColumn("prob", F.col("_e") / F.greatest(F.sum("_e").over(row()), F.lit(1e-12))).drop("_e")


def looks_like_probabilities(scores: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row `probabilities`: are all scores finite, between 0 and 1, and do each source's add up to 1?"""
    fine = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(-1e-6, 1 + 1e-6)
    return scores.groupBy("src_pos").agg(F.bool_and(fine).alias("ok"), F.sum("score").alias("s")).agg(F.coalesce(F.bool_and(F.col("ok") & (F.abs(F.col("s") - 1) < tolerance)), F.lit(False)).alias("probabilities"))


def row_max_normalized(scores: DataFrame, name: str = "score") -> DataFrame:
    return scores.withColumn(name, F.col(name) / F.greatest(F.max(name).over(row()), F.lit(1e-9)))


def global_max_normalized(scores: DataFrame, name: str = "score") -> DataFrame:
    """Divided by the largest score of all, if that is positive."""
    top = scores.agg(F.max(name).alias("_top"))  # one row
    return scores.crossJoin(F.broadcast(top)).withColumn(name, F.when(F.col("_top") > 0, F.col(name) / F.col("_top")).otherwise(F.col(name))).drop("_top")


def top1(probs: DataFrame, truth: DataFrame, conf: str = "prob") -> DataFrame:
    """(src_pos, tgt_pos, conf, correct) of each source's most likely target; a source without a truth is wrong."""
    best = probs.groupBy("src_pos").agg(F.max_by(F.struct("tgt_pos", conf), F.struct(F.col(conf), -F.col("tgt_pos"))).alias("b")).select("src_pos", "b.tgt_pos", F.col(f"b.{conf}").alias("conf"))
    return best.join(truth.withColumn("_hit", F.lit(1.0)), ["src_pos", "tgt_pos"], "left").select("src_pos", "tgt_pos", "conf", F.coalesce("_hit", F.lit(0.0)).alias("correct"))


def random_hit1(scores: DataFrame, truth: DataFrame, seed: int = 42) -> DataFrame:
    """Hit@1 after a seeded permutation of the targets, which changes ties alone."""
    order = Window.partitionBy("src_pos").orderBy(F.desc("score"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("tgt_pos").cast("string"))))
    r = with_truth(scores, truth).withColumn("rank", F.row_number().over(order))
    return r.where("relevant").groupBy("src_pos").agg(F.min("rank").alias("rank")).agg(F.round(hit(1), 6).alias("random_hit_at_1"))


def bootstrap_ci(values: DataFrame, n_boot: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(lower, upper): percentiles of the means of n_boot resamples of values(i, value), i gapless from 0.

    Draw j of resample b takes row md5(seed:b:j) mod n, so the same draws can be made anywhere. Resamples are counts
    of draws joined to the values; work is n_boot times the rows, dealt over all tasks.
    """
    n = values.count()
    spark = values.sparkSession
    draws = spark.range(n_boot).select(F.col("id").alias("b")).crossJoin(spark.range(n).select(F.col("id").alias("j")))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    means = draws.select("b", pick.alias("i")).join(values, "i").groupBy("b").agg(F.avg("value").alias("m"))
    return means.agg(F.round(F.percentile("m", alpha / 2), 6).alias("lower"), F.round(F.percentile("m", 1 - alpha / 2), 6).alias("upper"))


def choose_best(results: DataFrame) -> DataFrame:
    """The row with the best Hit@1, then MRR, then NDCG@5; a metric of zero counts as -1, ties keep the first `ord`."""
    key = [F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, -1.0).otherwise(F.col(c)).alias(c) for c in ("hit_at_1", "mrr", "ndcg_at_5")]
    return results.agg(F.max_by(F.struct(*results.columns), F.struct(*key, (-F.col("ord")).alias("o"))).alias("r")).select("r.*")


class Evaluator:
    """Metrics of one score table against one truth; what several metrics need is worked out once."""

    def __init__(self, scores: DataFrame, truth: DataFrame):
        self.scores, self.truth = scores, truth
        self.rows = per_source(scores, truth).persist()

    def summary(self) -> DataFrame:
        return summary(self.rows)

    def hit_at(self, k: int) -> float:
        return self.rows.agg(hit(k)).first()[0]

    def mrr(self) -> float:
        return self.rows.agg(F.avg(1.0 / F.col("rank"))).first()[0]

    def ece(self, n_bins: int = 15, tau: float = 1.0) -> float:
        from . import calibration

        have = self.scores.join(self.truth.select("src_pos").distinct(), "src_pos", "left_semi")
        return calibration.ece(top1(softmax(have, tau), self.truth), n_bins).first()[0]

    def bootstrap(self, metric: str, n_boot: int = 1000) -> DataFrame:
        value = {"hit@1": (F.col("rank") <= 1), "hit@3": (F.col("rank") <= 3), "hit@5": (F.col("rank") <= 5), "mrr": 1.0 / F.col("rank")}.get(metric.lower())
        if value is None:
            raise NotImplementedError(f"no bootstrap for {metric}")
        numbered = self.rows.select((F.row_number().over(Window.orderBy("src_pos")) - 1).cast("long").alias("i"), value.cast("double").alias("value"))
        return bootstrap_ci(numbered, n_boot)

    def close(self) -> None:
        self.rows.unpersist()
