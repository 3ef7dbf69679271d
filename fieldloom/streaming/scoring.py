"""Arriving source fields scored against a catalog of targets that stands still."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import lexical, matchers, ranking
from ..shipping import ship

#: A task keeps the best targets of so many distinct records, then starts anew.
KEPT = 50_000


class TokenIndex:
    """Token sets by number, and the numbers of the sets that hold a token."""

    def __init__(self, sets: list[set[str]]):
        self.sizes = np.array([len(s) for s in sets], dtype="int64")
        found: dict[str, list[int]] = {}
        for i, tokens in enumerate(sets):
            for t in tokens:
                found.setdefault(t, []).append(i)
        self.holders = {t: np.array(x) for t, x in found.items()}

    def jaccard(self, tokens: set[str]) -> np.ndarray:
        """Of a set with each of the index: shared tokens over all; 0 if either is empty."""
        hits = [self.holders[t] for t in tokens if t in self.holders]
        if not hits:
            return np.zeros(len(self.sizes))
        shared = np.bincount(np.concatenate(hits), minlength=len(self.sizes))
        return shared / (len(tokens) + self.sizes - shared)


def stream_top_k(fields: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """A stream of (field_id, name, type, path) with `best`, its k best targets as an array of (score, field_id).

    No state is kept between batches: the catalog, counted and bounded like in any broadcast, goes to the executors as
    an index of tokens when the stream is declared, and each row is scored in place, so rows may come in any order and
    late ones are like others. A task scores a record once, however many rows have its name, type and path tokens.
    """
    if targets.count() > matchers.all_pairs.__defaults__[0]:
        raise ValueError("the catalog is too large to stand beside each row; use score_each_batch")
    ship(fields.sparkSession)
    one = targets.select("pos", "field_id", X.plain_tokens("name").alias("ntok"), X.path_tokens("path").alias("ptok"), X.type_base("type").alias("tbase"))
    rows = one.orderBy("pos", "field_id").collect()
    ids, types = np.array([r.field_id for r in rows], dtype=object), np.array([r.tbase for r in rows], dtype=object)
    names, paths = TokenIndex([set(r.ntok) for r in rows]), TokenIndex([set(r.ptok) for r in rows])

    def best_of(name: str, type_: str, path: str) -> tuple[list[float], list[str]]:
        same = (types == type_).astype(float) if type_ else np.zeros(len(types))
        # no token of a name has a space, none of a path a dot
        parts = names.jaccard({t for t in name.split(" ") if t}), same, paths.jaccard({t for t in path.split(".") if t})
        score = lexical.half_up(matchers.weighted(*parts, 0.3, 0.5, 0.2))
        order = np.argsort(-score, kind="stable")[:k]
        return score[order].tolist(), ids[order].tolist()

    @F.pandas_udf("score array<double>, field_id array<string>")
    def best_targets(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str, str], tuple[list[float], list[str]]] = {}
        for batch in batches:
            out = []
            for record in zip(*batch):
                if record not in seen:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[record] = best_of(*record)
                out.append(seen[record])
            yield pd.DataFrame({"score": [x[0] for x in out], "field_id": [x[1] for x in out]})

    found = best_targets(F.array_join(X.plain_tokens("name"), " "), X.type_base("type"), F.array_join(X.path_tokens("path"), "."))
    return fields.withColumn("_best", found).select(*fields.columns, F.arrays_zip("_best.score", "_best.field_id").alias("best"))


def score_each_batch(fields: DataFrame, targets: DataFrame, matcher: str, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5) -> StreamingQuery:
    """Any registered matcher on each micro-batch of fields; sink gets the ranked pairs and the batch's number.

    A batch that is run again after a failure has the same number, so a sink that writes by it is exactly once.
    """

    def one(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("pos", F.xxhash64("field_id"))
        sink(ranking.top_k(matchers.score(matcher, numbered, targets), k).join(numbered.select(F.col("pos").alias("src_pos"), "field_id"), "src_pos"), number)

    return fields.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
