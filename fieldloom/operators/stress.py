"""Robustness: one signal of the catalogs is masked or drifts at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from .matchers import Matcher, overlap_matcher, overlap_score
from .pairs import all_pairs
from .ranking import per_source, per_source_of, summary

#: What each setting does to (a source, a target). Drift touches sources alone.
SETTINGS: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {
    "Original": (lambda c: c, True),
    "MaskName": (lambda c: c.withColumn("name", F.lit("")), True),
    "MaskType": (lambda c: c.withColumn("type", F.lit("")), True),
    "MaskPath": (lambda c: c.withColumn("path", F.lit("")), True),
    "PathDrift": (lambda c: c.withColumn("path", X.drift_path("path")), False),
    "TypeDrift": (lambda c: c.withColumn("type", X.drift_type("type")), False),
}


def perturb_text(df: DataFrame, text: str = "text", path_drift: bool = False, type_drift: bool = False) -> DataFrame:
    """Drift in serialised texts: the path first, then the type."""
    if path_drift:
        df = df.withColumn(text, X.drift_tagged(text, "PATH", X.drift_path))
    if type_drift:
        df = df.withColumn(text, X.drift_tagged(text, "TYPE", X.drift_type))
    return df


def overlap_settings(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """The flagship matcher's scores under every setting as columns of one product: masked signals are 0, drift changes sources."""
    words = [X.plain_tokens("name").alias("names"), X.path_tokens("path").alias("paths")]
    a = src.select("pos", *words, X.path_tokens(X.drift_path("path")).alias("drift_paths"), X.type_base("type").alias("tbase"), X.type_base(X.drift_type("type")).alias("drift_type"))
    b = tgt.select("pos", *words, X.type_base("type").alias("tbase"))
    names = S.TokenSets.over(a.select("names"), b.select("names"))
    paths = S.TokenSets.over(a.select("paths"), a.select("drift_paths"), b.select("paths"))
    sets = lambda df: [c for c in ("names", "paths", "drift_paths") if c in df.columns]
    encoded = lambda df: df.withColumns({c: (names if c == "names" else paths).encode(F.col(c)) for c in sets(df)})
    rows = all_pairs(encoded(a), encoded(b))
    same = lambda c: ((F.col(c) == F.col("tgt_tbase")) & (F.col(c) != "")).cast("double")
    c = F.col
    rows = rows.select("src_pos", "tgt_pos", names.jaccard(c("src_names"), c("tgt_names")).alias("_n"), same("src_tbase").alias("_t"), paths.jaccard(c("src_paths"), c("tgt_paths")).alias("_p"), paths.jaccard(c("src_drift_paths"), c("tgt_paths")).alias("_dp"), same("src_drift_type").alias("_dt"))
    n, t, p, none = F.col("_n"), F.col("_t"), F.col("_p"), F.lit(0.0)
    signals = {"Original": (n, t, p), "MaskName": (none, t, p), "MaskType": (n, none, p), "MaskPath": (n, t, none), "PathDrift": (n, t, F.col("_dp")), "TypeDrift": (n, F.col("_dt"), p)}
    return rows.select("src_pos", "tgt_pos", *[overlap_score(*s).alias(name) for name, s in signals.items()])


def stress(src: DataFrame, tgt: DataFrame, truth: DataFrame, matcher: Matcher) -> DataFrame:
    """Metrics for each setting, one row each; the flagship's settings share one product, other matchers run once for each."""
    if matcher is overlap_matcher:
        return summary(per_source_of(overlap_settings(src, tgt), truth, list(SETTINGS)), "setting")
    rows = []
    for name, (change, both) in SETTINGS.items():
        scores = matcher(change(src), change(tgt) if both else tgt)
        rows.append(per_source(scores, truth).withColumn("setting", F.lit(name)))
    return summary(reduce(DataFrame.unionByName, rows), "setting")
