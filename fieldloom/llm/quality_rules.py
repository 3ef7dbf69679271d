"""Quality rules with risk-controlled thresholds.

Every text gets counts (below). A rule is a ratio of counts with a cutoff; which cutoff is chosen from labelled
documents so that, in every stratum of text length, the chance of rejecting a document labelled good is bounded: the
exact (Clopper-Pearson) upper bound of each candidate's false-rejection rate must be at most the rule's share of the
allowed risk. Candidates of a stratum and rule are tested from the loosest on, a fixed order that needs no correction
as it stops at the first that fails; over strata and rules the level is divided by their number (Bonferroni).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, text_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
#: Lower ends of the strata, in words.
STRATA = (0, 50, 200, 800)
#: The share of good documents that all rules together may reject in a stratum, and the chance that a bound is wrong.
RISK, LEVEL = 0.02, 0.05
#: A candidate cutoff is a multiple of 1 / GRID; ratios are at most 1.
GRID = 64


def count_text(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one whole text."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = with_word = 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            with_word += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        first: dict[tuple, int] = {}
        again = set()
        for i, w in enumerate(windows):
            if first.setdefault(w, i) != i:
                again.add(w)
        if again:
            upto = 0
            for i, w in enumerate(windows):
                if w in again:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    joined = "".join(words)
    symbols = sum(map(text.count, "#*$%&|<>"))
    upper = len(joined) - len(joined.translate(_UPPER))
    return n, len(joined), symbols, dup, repeat, upper, with_word


_UPPER = dict.fromkeys(range(65, 91))


def count_rows(batch: list[tuple]) -> Iterator[tuple]:
    for key, text in batch:
        yield (key, *count_text(text))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) for every row; a null text has no words and no lines."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS), count_rows)


def base_failed(c=F.col) -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.least(F.col(part) / F.col(whole), F.lit(1.0))).otherwise(F.lit(0.0))


#: A document is rejected by a rule if the ratio is over the cutoff that was chosen for its stratum.
RULES = {
    "symbols": lambda: share("n_symbols", "word_chars"),
    "capitals": lambda: share("n_upper", "word_chars"),
    "repeated_words": lambda: share("n_repeat_words", "n_words"),
    "repeated_lines": lambda: share("n_dup_lines", "n_lines"),
    "symbols_per_word": lambda: share("n_symbols", "n_words"),
}


def stratum() -> Column:
    out = F.lit(0)
    for i, low in enumerate(STRATA):
        out = F.when(F.col("n_words") >= low, i).otherwise(out)
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), summed in logarithms from the largest term down."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    lp, lq = math.log(p), math.log1p(-p)
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq
    total, top = 0.0, min(k, int((n + 1) * p))
    for i in range(top, -1, -1):
        x = math.exp(term(i))
        total += x
        if x < 1e-18 * total:
            break
    for i in range(top + 1, k + 1):
        x = math.exp(term(i))
        total += x
        if x < 1e-18 * total:
            break
    return min(1.0, total)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n have at least the chance `level`."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > level else (low, mid)
    return high


def choose_cutoffs(histogram: dict[tuple[int, str], dict[int, int]], risk: float, level: float) -> dict[tuple[int, str], float]:
    """For each (stratum, rule) the last cutoff, from the loosest on, before the first whose bound does not fit, or none.

    histogram: good documents by grid cell of the rule's ratio; cell i holds ratios in (i-1, i] / GRID.
    """
    tests = len(STRATA) * len(RULES)
    out = {}
    for (s, rule), cells in histogram.items():
        n, over = sum(cells.values()), 0
        for cut in range(GRID, -1, -1):  # documents over cut / GRID are those in cells above cut
            over += cells.get(cut + 1, 0)
            if upper_bound(over, n, level / tests) > risk / len(RULES):
                break
            if cut < GRID:
                out[s, rule] = cut / GRID
    return out


def fit_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[tuple[int, str], float]:
    """Cutoffs from all rows of labels(doc_id, quality) that counts has.

    What comes to the driver is a histogram of len(STRATA) x len(RULES) x (GRID + 1) cells, whatever the input.
    """
    good = counts.where(~base_failed()).join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    cells = good.select(stratum().alias("s"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(f() * GRID).cast("int").alias("cell")) for r, f in RULES.items()])).alias("x"))
    histogram: dict[tuple[int, str], dict[int, int]] = {}
    for row in cells.groupBy("s", "x.rule", "x.cell").count().collect():
        histogram.setdefault((row[0], row[1]), {})[row[2]] = row[3]
    return choose_cutoffs(histogram, risk, level)


def rejected_by_rules(cutoffs: dict[tuple[int, str], float]) -> Column:
    out = F.lit(False)
    for (s, rule), cut in sorted(cutoffs.items()):
        out = out | ((stratum() == s) & (RULES[rule]() > cut))
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(doc_id, COUNTS..., base_failed, kept) for every row of docs.

    risk bounds the chance of rejecting a good document that passes the base, in each stratum, with confidence
    1 - level over all strata, rules and cutoffs. A stratum with too few labels gets no cutoff and rejects nothing
    beyond the base. Null and empty texts fail the base. Repeated rows get a row each; nothing but the two columns is
    read. An empty table gives an empty table.
    """
    counts = saved(text_counts(docs, id_col, text_col), "counts")
    cutoffs = fit_cutoffs(counts, labels, risk, level)
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected_by_rules(cutoffs))


def keep_by_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of docs that apply_rules() keeps, with all their columns.

    The verdict needs the text and the cutoffs alone, so texts are counted again where they are read: twice the
    counting, but no text is shuffled to meet its verdict.
    """
    cutoffs = fit_cutoffs(saved(text_counts(docs, id_col, text_col), "counts"), labels, risk, level)
    schema = ", ".join(f"{c} long" for c in COUNTS)

    @F.pandas_udf(schema)
    def counts_of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_text(t) for t in texts], columns=COUNTS)

    counted = docs.select(F.struct("*").alias("row"), counts_of(text_of(text_col)).alias("counts")).select("row", "counts.*")
    return counted.where(~base_failed() & ~rejected_by_rules(cutoffs)).select("row.*")
