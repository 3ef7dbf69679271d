"""Evaluation plans: one matcher, all matchers, components, calibration, stress, latency, statistics."""

from __future__ import annotations

import json
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assignment, calibration, matchers, pairs, ranking, stress
from ..sources import catalog


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against kinds of part: component similarities by built-ins, ranks, Hit@k, MRR and NDCG@k."""
    src, tgt, truth = part_setup(spark, sf_dir)
    return ranking.metrics(matchers.overlap_matcher(src, tgt), truth)


def part_setup(spark: SparkSession, sf_dir: str, same_type: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    src, tgt = catalog.part_sources(spark, sf_dir), catalog.part_targets(spark, sf_dir)
    return src, tgt, pairs.truth(catalog.part_pairs(spark, sf_dir, same_type), src, tgt)


def single(src: DataFrame, tgt: DataFrame, pair_table: DataFrame, matcher: str = "rule", config: catalog.RunConfig | None = None, constrain: bool = False, calibrate: bool = False, assign: bool = False, calib_pairs: DataFrame | None = None, n_boot: int = 0) -> dict:
    """One matcher: ranking metrics, calibration error, and what else is asked for, as a flat dictionary.

    Calibration uses calib_pairs where they are given, and all of pair_table is evaluated; else a share of its sources.
    n_boot resamples give intervals of Hit@1, Hit@3, Hit@5 and MRR.
    """
    c = config or catalog.RunConfig()
    began = time.time()
    split = calibration_pairs(pair_table, calib_pairs, c) if calibrate else pair_table.withColumn("part", F.lit("eval"))
    truth = pairs.truth(split.where("part = 'eval'"), src, tgt).persist()
    scores = matchers.score(matcher, src, tgt)
    if constrain:
        scores = matchers.constrained(scores, src, tgt, c.alpha, c.beta, c.gamma, c.delta)
    scores = scores.persist()
    out = {"matcher": matcher, **ranking.metrics(scores, truth).first().asDict()}
    of_eval = scores.join(truth.select("src_pos").distinct(), "src_pos", "left_semi")
    probs = ranking.softmax(of_eval)
    out["ece"] = calibration.ece(ranking.top1(probs, truth), c.ece_bins).first()[0]
    if calibrate:
        both = calibration.calibrate(scores, truth, pairs.truth(split.where("part = 'calib'"), src, tgt))
        if both:
            probs = both[1]
            out["ece_after"] = calibration.ece(ranking.top1(probs, truth), c.ece_bins).first()[0]
    if assign:
        # after calibration probabilities, not their logarithms, are held against the threshold
        table = probs.select("src_pos", "tgt_pos", F.col("prob").alias("score")) if calibrate else of_eval
        row = assignment.assignment_accuracy(assignment.assign(table, c.assign_tau), truth).first()
        out |= {"assign_accuracy": row.accuracy, "assign_coverage": row.coverage}
    if n_boot:
        evaluator = ranking.Evaluator(scores, truth)
        for metric in ("hit@1", "hit@3", "hit@5", "mrr"):
            row = evaluator.bootstrap(metric, n_boot).first()
            out[f"{metric}_ci"] = [row.lower, row.upper]
        evaluator.close()
    out["timing_sec"] = round(time.time() - began, 3)
    scores.unpersist()
    truth.unpersist()
    return out


def calibration_pairs(pair_table: DataFrame, calib_pairs: DataFrame | None, c: catalog.RunConfig) -> DataFrame:
    """pairs with `part`: those of another table calibrate, or else a share of the sources."""
    if calib_pairs is None:
        return pairs.split_by_source(pair_table, c.calib_ratio, c.calib_seed)
    return pair_table.select("source", "target", F.lit("eval").alias("part")).union(calib_pairs.select("source", "target", F.lit("calib")))


def sweep(src: DataFrame, tgt: DataFrame, pair_table: DataFrame, names: list[str] | None = None) -> dict[str, dict]:
    """Every matcher by itself; one that fails reports its error and does not stop the others."""
    out = {}
    for name in names or sorted(matchers.MATCHERS):
        try:
            out[name] = single(src, tgt, pair_table, name)
        except Exception as e:  # noqa: BLE001
            out[name] = {"matcher": name, "error": str(e).splitlines()[0]}
    return out


def component_table(src: DataFrame, tgt: DataFrame, truth: DataFrame, w_name: float = 0.4, w_type: float = 0.2, w_path: float = 0.4) -> DataFrame:
    """Metrics of the name, type and path scores alone and of their weighted mean, one row each."""
    parts = matchers.component_scores(src, tgt)
    of = {"name": F.col("name_score"), "type": F.col("type_score"), "path": F.col("path_score"), "weighted": matchers.weighted(F.col("name_score"), F.col("type_score"), F.col("path_score"), w_name, w_type, w_path)}
    rows = [ranking.per_source(parts.select("src_pos", "tgt_pos", F.round(value, 6).alias("score")), truth).withColumn("setting", F.lit(name)) for name, value in of.items()]
    return ranking.summary(reduce(DataFrame.unionByName, rows), "setting")


def calibration_table(scores: DataFrame, pair_table: DataFrame, src: DataFrame, tgt: DataFrame, config: catalog.RunConfig | None = None, calib_pairs: DataFrame | None = None) -> DataFrame:
    """Calibration error before and after, over sources that did not calibrate, with the same bins, and the improvement."""
    c = config or catalog.RunConfig()
    split = calibration_pairs(pair_table, calib_pairs, c)
    truth = pairs.truth(split.where("part = 'eval'"), src, tgt)
    both = calibration.calibrate(scores, truth, pairs.truth(split.where("part = 'calib'"), src, tgt))
    if both is None:
        return scores.sparkSession.createDataFrame([], "ece_before double, ece_after double, improvement double")
    before, after = (calibration.ece(ranking.top1(p, truth), c.ece_bins).withColumnRenamed("ece", name) for p, name in zip(both, ("ece_before", "ece_after")))
    return before.crossJoin(after).withColumn("improvement", F.round(F.when(F.col("ece_before") > 0, (F.col("ece_before") - F.col("ece_after")) / F.col("ece_before")).otherwise(0.0), 6))


def calibrated_matches(src: DataFrame, tgt: DataFrame, calib_pairs: DataFrame, matcher: str = "overlap") -> DataFrame:
    """(src_pos, tgt_pos, conf, fitted): each source's best target, its score, and the chance that it is right.

    The chance is an isotonic fit of the truth on the largest scores of the sources that calib_pairs names.
    """
    scores = matchers.score(matcher, src, tgt)
    known = pairs.truth(calib_pairs, src, tgt)
    named = scores.join(known.select("src_pos").distinct(), "src_pos", "left_semi")
    model = calibration.fit_isotonic(ranking.top1(named, known, "score"))
    return calibration.predict(model, ranking.top1(scores, known, "score")).select("src_pos", "tgt_pos", "conf", "fitted")


def latency(src: DataFrame, tgt: DataFrame, matcher: str = "overlap") -> dict[str, float]:
    """Seconds of serialisation, scoring, ranking and softmax, each materialised by a sink that keeps nothing."""
    from ..functions import text as X

    n = src.count()

    def timed(df: DataFrame) -> float:
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - began

    scores = matchers.score(matcher, src, tgt).persist()
    out = {
        "encode_a_sec": timed(src.select(X.serialize())),
        "encode_b_sec": timed(tgt.select(X.serialize())),
        "score_sec": timed(scores),
        "rank_sec": timed(ranking.top_k(scores, 5)),
        "calibration_sec": timed(ranking.softmax(scores)),
    }
    scores.unpersist()
    out["total_sec"] = sum(out.values())
    out["ms_per_source"] = 1000 * out["total_sec"] / max(n, 1)
    return {k: round(v, 4) for k, v in out.items()}


def latency3(src: DataFrame, tgt: DataFrame, matcher: str = "overlap") -> dict[str, float]:
    """latency() in three stages: texts, scores with ranks, softmax."""
    one = latency(src, tgt, matcher)
    out = {"embed_sec": one["encode_a_sec"] + one["encode_b_sec"], "score_rank_sec": one["score_sec"] + one["rank_sec"], "calibration_sec": one["calibration_sec"]}
    out["total_sec"] = sum(out.values())
    out["ms_per_source"] = one["ms_per_source"]
    return {k: round(v, 4) for k, v in out.items()}


def benchmark(src: DataFrame, tgt: DataFrame, pair_table: DataFrame, path: str | None = None) -> dict:
    """All tables in one run over shared catalogs; written as JSON where a path is given."""
    truth = pairs.truth(pair_table, src, tgt)
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a few rows each
    out = {
        "matchers": sweep(src, tgt, pair_table),
        "components": rows(component_table(src, tgt, truth)),
        "calibration": rows(calibration_table(matchers.overlap_matcher(src, tgt), pair_table, src, tgt)),
        "stress": rows(stress.stress(src, tgt, truth, matchers.overlap_matcher)),
        "latency": latency(src, tgt),
        "dataset": rows(pairs.dataset_stats(pair_table, src, tgt)),
    }
    if path:
        Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False))
    return out


MODES = ("single", "all", "table3", "table4", "stress", "latency", "latency3", "dataset_stats")


def run(spark: SparkSession, fields_a: str, fields_b: str, pair_file: str, mode: str = "single", matcher: str = "rule", pairs_calib: str | None = None, weights: tuple[float, float, float] = (0.4, 0.2, 0.4), **options) -> dict:
    """A mode over catalogs and pairs in JSON-lines files; what the command line calls."""
    calib = catalog.read_pairs(spark, pairs_calib) if pairs_calib else None
    src, tgt, table = catalog.read_catalog(spark, fields_a), catalog.read_catalog(spark, fields_b), catalog.read_pairs(spark, pair_file)
    truth = pairs.truth(table, src, tgt)
    rows = lambda df: [r.asDict() for r in df.collect()]
    if mode == "single":
        return single(src, tgt, table, matcher, calib_pairs=calib, **options)
    if mode == "all":
        return sweep(src, tgt, table)
    if mode == "table3":
        return {r["setting"]: r for r in rows(component_table(src, tgt, truth, *weights))}
    if mode == "table4":
        return (rows(calibration_table(matchers.score(matcher, src, tgt), table, src, tgt, calib_pairs=calib)) or [{}])[0]
    if mode == "stress":
        return {r["setting"]: r for r in rows(stress.stress(src, tgt, truth, matchers.MATCHERS[matcher]))}
    if mode == "latency":
        return latency(src, tgt, matcher)
    if mode == "latency3":
        return latency3(src, tgt, matcher)
    if mode == "dataset_stats":
        return rows(pairs.dataset_stats(table, src, tgt))[0]
    raise ValueError(f"unknown mode {mode}; there are {MODES}")
