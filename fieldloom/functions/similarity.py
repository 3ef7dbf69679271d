"""Similarities of two field records, as Column expressions; the one that Spark lacks is a pandas UDF."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as X
from . import vocabulary as V


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


class TokenSets:
    """Token sets as a pair of records compares them quickest.

    Over a vocabulary of at most MOST words, which is counted and brought to the driver, a set is its size and a bit for
    each word, and what two sets share is counted in a few machine instructions. Over a larger one it is 64-bit hashes.
    """

    MOST = 768

    def __init__(self, words: list[str] | None):
        self.words = words

    @classmethod
    def over(cls, *sets: DataFrame) -> TokenSets:
        """The sets of tables with one array column each."""
        words = [r.w for r in reduce(DataFrame.union, [df.select(F.explode(df.columns[0]).alias("w")) for df in sets]).distinct().limit(cls.MOST + 1).collect()]
        return cls(sorted(words) if len(words) <= cls.MOST else None)

    def encode(self, tokens: Column) -> Column:
        if self.words is None:
            return X.hashed(tokens)
        places = F.array_distinct(F.transform(tokens, lambda t: F.array_position(X.constant(self.words, "array<string>"), t).cast("int") - 1))

        def word(w: int) -> Column:
            bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)
            return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.when(F.shiftright(i, 6) == w, acc.bitwiseOR(bit(i))).otherwise(acc))

        words = [word(w) for w in range(-(-len(self.words) // 64))]
        return F.struct(F.size(places).alias("n"), *[c.alias(f"w{w}") for w, c in enumerate(words)])

    def size(self, a: Column) -> Column:
        return F.size(a) if self.words is None else a["n"]

    def shared(self, a: Column, b: Column) -> Column:
        """How many members two sets share."""
        if self.words is None:
            return F.size(F.array_intersect(a, b))
        return reduce(lambda x, y: x + y, [F.bit_count(a[f"w{w}"].bitwiseAND(b[f"w{w}"])) for w in range(-(-len(self.words) // 64))], F.lit(0))

    def jaccard(self, a: Column, b: Column, both: Column | None = None) -> Column:
        """Shared members over all; 0 if either set is empty. both is what they share, where it is known."""
        both = self.shared(a, b) if both is None else both
        return F.when((self.size(a) == 0) | (self.size(b) == 0), 0.0).otherwise(both / (self.size(a) + self.size(b) - both))

    def overlap(self, a: Column, b: Column, both: Column | None = None) -> Column:
        both = self.shared(a, b) if both is None else both
        return F.when((self.size(a) == 0) | (self.size(b) == 0), 0.0).otherwise(both / F.least(self.size(a), self.size(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def compatibility(table: dict[tuple[str, str], float], a: Column, b: Column) -> Column:
    """table[a, b] either way round, else 0. Types have no vertical bar."""
    both = table | {(y, x): v for (x, y), v in table.items()}
    return F.coalesce(F.element_at(X.constant({f"{s}|{t}": v for (s, t), v in both.items()}, "map<string, double>"), F.concat(a, F.lit("|"), b)), F.lit(0.0))


def type_compat_a(a: Column | str, b: Column | str) -> Column:
    return compatibility(V.TYPE_COMPAT_A, X.type_base(a), X.type_base(b))


def type_compat_b(a: Column | str, b: Column | str) -> Column:
    """Of canonical types, as canonical_type() gives them."""
    return compatibility(V.TYPE_COMPAT_B, X.col(a), X.col(b))


def exact_type(a: Column | str, b: Column | str) -> Column:
    return ((X.type_base(a) == X.type_base(b)) & (X.type_base(a) != "")).cast("double")


def polarity(tokens: Column) -> tuple[Column, Column]:
    """(has a word for a source, has a word for a destination)."""
    return F.arrays_overlap(tokens, X.tokens_of(" ".join(V.SOURCE_WORDS))), F.arrays_overlap(tokens, X.tokens_of(" ".join(V.DESTINATION_WORDS)))


def polarity_penalty(a: Column, b: Column) -> Column:
    (a_src, a_dst), (b_src, b_dst) = polarity(a), polarity(b)
    return ((a_src & b_dst) | (a_dst & b_src)).cast("double")


def polarity_bonus(a: Column, b: Column) -> Column:
    (a_src, a_dst), (b_src, b_dst) = polarity(a), polarity(b)
    return F.when((a_src & b_src) | (a_dst & b_dst), 0.35).otherwise(0.0)


def end_bonus(a: Column, b: Column) -> Column:
    """For token lists: equal last, first, last two and first two tokens add up."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    two = (F.size(a) >= 2) & (F.size(b) >= 2)
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    at = lambda x, i: F.get(x, i)
    last = lambda x: at(x, F.size(x) - 1)
    before = lambda x: at(x, F.size(x) - 2)
    return (
        part(some & (last(a) == last(b)), 0.30)
        + part(some & (at(a, F.lit(0)) == at(b, F.lit(0))), 0.15)
        + part(two & (last(a) == last(b)) & (before(a) == before(b)), 0.35)
        + part(two & (at(a, F.lit(0)) == at(b, F.lit(0))) & (at(a, F.lit(1)) == at(b, F.lit(1))), 0.20)
    )


def cross_bonus(a_name: Column, b_name: Column, a_path: Column, b_path: Column) -> Column:
    """Names that turn up in the other's path."""
    j = F.greatest(jaccard(a_name, b_path), jaccard(b_name, a_path))
    o = F.greatest(overlap(a_name, b_path), overlap(b_name, a_path))
    return F.when(j >= 0.8, 0.55).when(j >= 0.5, 0.30).when(j > 0, 0.10).otherwise(0.0) + F.when(o >= 0.8, 0.28).when(o >= 0.5, 0.15).otherwise(0.0)


def bare_name(c: Column | str) -> Column:
    """The name in lower case without underscores and what is no word character in any script."""
    return F.regexp_replace(F.lower(X.text(c)), r"(?U)[_\W]+", "")


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all, matched by longest common blocks; 0 if either is empty."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Run it on distinct pairs of names; see operators.pairs.by_distinct."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")
