"""BM25 and TF-IDF by inverted index: terms are exploded, joined on the term and summed per pair."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, no_tokens
from ..shared import again, saved
from ..shipping import ship
from .ranking import top_k


#: Postings of a term that one task takes of either side, about.
POSTINGS = 16_000


def join_terms(a: DataFrame, b: DataFrame, term: list[str], a_id: str, b_id: str, rows: int) -> DataFrame:
    """a and b joined on a term, where no term stands in more than `rows` texts of a side. A term that many rows of a
    side hold is cut into parts of about POSTINGS rows, by which the other side is repeated, so that the products of a
    common word are made by many tasks."""
    if rows <= POSTINGS:
        return a.join(b, term)
    parts = lambda df, name: df.groupBy(*term).agg(F.ceil(F.count("*") / POSTINGS).cast("int").alias(name))
    sizes = parts(a, "_pa").join(parts(b, "_pb"), term)

    def side(df: DataFrame, key: str, mine: str, its: str, all_: str, other: str) -> DataFrame:
        own = df.join(sizes, term).withColumn(mine, F.pmod(F.xxhash64(key), F.col(its)).cast("int"))
        return own.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(all_) - 1))).drop("_pa", "_pb")

    return side(a, a_id, "_i", "_pa", "_pb", "_j").join(side(b, b_id, "_j", "_pb", "_pa", "_i"), [*term, "_i", "_j"]).drop("_i", "_j")


def bm25_tables(docs: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """((tgt_pos, term, f, norm), (term, idf)) of docs(tgt_pos, tokens)."""
    terms = docs.select("tgt_pos", F.explode("tokens").alias("term")).groupBy("tgt_pos", "term").agg(F.count("*").alias("f"))
    lengths = docs.select("tgt_pos", F.size("tokens").alias("dl"))
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))  # one row
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    norm = lengths.crossJoin(F.broadcast(size)).select("tgt_pos", (k1 * (1 - b + b * F.col("dl") / (F.col("avgdl") + 1e-9))).alias("norm"))
    return terms.join(norm, "tgt_pos"), idf


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(src_pos, tgt_pos, score) of the pairs that share a term, from queries(src_pos, tokens), docs(tgt_pos, tokens).

    A query term counts as often as it stands there. Pairs without a row have the score 0.
    """
    terms, idf = bm25_tables(docs, k1, b)
    asked = queries.select("src_pos", F.explode("tokens").alias("term")).groupBy("src_pos", "term").agg(F.count("*").alias("qf")).join(idf, "term")
    hits = join_terms(asked, terms, ["term"], "src_pos", "tgt_pos", max(queries.count(), docs.count()))
    part = F.col("qf") * F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + F.col("norm"))
    return hits.groupBy("src_pos", "tgt_pos").agg(F.sum(part).alias("score"))


def bm25_vectors(docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(tgt_pos, t, w) of docs(tgt_pos, tokens): hashes of its terms, and what each adds to the score of a query that
    holds it once."""
    terms, idf = bm25_tables(docs, k1, b)
    part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + F.col("norm"))
    return terms.join(idf, "term").groupBy("tgt_pos").agg(F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list(part).alias("w"))


def word_terms(tokens: Column) -> Column:
    """Tokens, and neighbouring tokens joined by a space."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.when(F.size(tokens) > 1, F.concat(tokens, pairs)).otherwise(tokens)


def char_terms(text: Column, low: int = 2, high: int = 6) -> Column:
    """Runs of low to high characters within words that have a space on both sides; a shorter word gives itself, once."""
    words = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(w: Column) -> Column:
        # a word shorter than the shortest run gives itself; one between gives its runs up to its own length
        short = F.when(F.length(w) < low, F.array(w)).otherwise(no_tokens())
        return F.concat(short, *[grams(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words, runs))


def tfidf_weights(terms: DataFrame, max_df: float) -> DataFrame:
    """(doc, term, w) from terms(doc, _copies, terms): sublinear counts, smoothed idf, unit length; terms in more than max_df of the documents go."""
    size = terms.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n"))  # one row
    # counted here and again for the document frequencies
    counts = saved(terms.select("doc", "_copies", F.explode("terms").alias("term")).groupBy("doc", "_copies", "term").agg(F.count("*").alias("tf")), "counts")
    df = counts.groupBy("term").agg(F.sum("_copies").alias("df")).crossJoin(F.broadcast(size)).where(F.col("df") <= max_df * F.col("n"))
    raw = counts.join(df, "term").select("doc", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc"))))


def tfidf_units(corpus: DataFrame, tokens: Column, text: Column) -> DataFrame:
    """(doc, is_source, block, term, w): the unit vectors of corpus(doc, text, is_source).

    The features of a text are a character block and a word block of unit length each, side by side. The corpus
    should hold each distinct text once for each time it counts: `doc` tells them apart. Or it has a column `_copies`,
    of how many equal documents a row stands for.
    """
    corpus = corpus if "_copies" in corpus.columns else corpus.withColumn("_copies", F.lit(1).cast("long"))
    blocks = {"c": (char_terms(text), 0.95), "w": (word_terms(tokens), 0.98)}
    weights = None
    for name, (terms, max_df) in blocks.items():
        w = tfidf_weights(corpus.select("doc", "_copies", terms.alias("terms")), max_df).withColumn("block", F.lit(name))
        weights = w if weights is None else weights.union(w)
    side = corpus.select("doc", "is_source")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    # both sides of a product read it
    return saved(weights.select("doc", "block", "term", (F.col("w") / length).alias("w")).join(side, "doc"), "weights")


def tfidf_cosine(corpus: DataFrame, tokens: Column, text: Column) -> DataFrame:
    """(a, b, score) for source texts a and target texts b of corpus(doc, text, is_source) that share a term."""
    unit = tfidf_units(corpus, tokens, text)
    a = unit.where("is_source").select(F.col("doc").alias("a"), "block", "term", F.col("w").alias("wa"))
    b = unit.where("not is_source").select(F.col("doc").alias("b"), "block", "term", F.col("w").alias("wb"))
    return join_terms(a, b, ["block", "term"], "a", "b", corpus.count()).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


#: (row, term, weight) of the entries of sparse vectors
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def shared_sums(a: Entries, b: Entries, shape: tuple[int, int], terms: int = 4096) -> np.ndarray:
    """The sum of the products of the weights of shared terms, for every row of a and of b; a matrix product of some
    thousand shared terms at a time. A term that stands in a row twice has the sum of its weights."""
    shared, out = np.intersect1d(a[1], b[1]), np.zeros(shape)

    def dense(entries: Entries, some: np.ndarray, n: int) -> np.ndarray:
        row, term, w = entries
        at = np.minimum(np.searchsorted(some, term), len(some) - 1)
        here = some[at] == term
        return np.bincount(row[here] * len(some) + at[here], w[here], n * len(some)).reshape(n, len(some))

    for low in range(0, len(shared), terms):
        some = shared[low : low + terms]
        out += dense(a, some, shape[0]) @ dense(b, some, shape[1]).T
    return out


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as Spark's round() does it: a half of the shortest decimal goes away from zero."""
    scaled = x * 10.0**digits
    out = np.round(scaled) / 10.0**digits
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    out[near] = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in x[near]]
    return out


def tile_scores(src: DataFrame, tgt: DataFrame, parts: dict[str, tuple[float, str]], k: int | None = None, digits: int = 6, tile: int = 1000) -> DataFrame:
    """(src_pos, tgt_pos, score) of all pairs: the weighted sum of several scores of their sparse vectors.

    Both sides are (pos, part, t, w): a row for each record and part, the hashes of its terms and their weights, a null w
    being ones. parts has the weight and the kind of each part: `sum` of the products of shared terms; `row_max`, that
    divided by the source's largest; `jaccard`, shared terms over all. Both sides are dealt into tiles of about `tile`
    records, and a pair of tiles is a product of two matrices for each part. With k, the k best targets of each source
    by the rounded score leave a tile, with `rank`; ties go to the smaller position.
    """
    ship(src.sparkSession)
    n_s, n_t = (max(1, -(-df.select("pos").distinct().count() // tile)) for df in (src, tgt))
    none = {"src_pos": "int64", "tgt_pos": "int64", "score": "float64"}

    def entries(side: pd.DataFrame, part: str, at: np.ndarray) -> Entries:
        own = side[side["part"] == part]
        sizes = [len(t) for t in own["t"]]
        w = [np.ones(n) if x is None else x for n, x in zip(sizes, own["w"])]
        return np.repeat(np.searchsorted(at, own["pos"].to_numpy()), sizes), np.concatenate([np.zeros(0, "int64"), *own["t"]]), np.concatenate([np.zeros(0), *w])

    def sums(a: pd.DataFrame, b: pd.DataFrame, part: str) -> tuple[np.ndarray, Entries, Entries]:
        at_a, at_b = np.unique(a["pos"]), np.unique(b["pos"])
        x, y = entries(a, part, at_a), entries(b, part, at_b)
        return shared_sums(x, y, (len(at_a), len(at_b))), x, y

    def largest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        some = [pd.DataFrame({"pos": np.unique(a["pos"]), "part": name, "top": sums(a, b, name)[0].max(1)}) for name, (_, kind) in parts.items() if kind == "row_max" and len(a) and len(b)]
        return pd.concat([pd.DataFrame({"pos": pd.Series(dtype="int64"), "part": pd.Series(dtype=object), "top": pd.Series(dtype="float64")}), *some])

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in none.items()})
        at_a, at_b = np.unique(a["pos"]), np.unique(b["pos"])
        total = np.zeros((len(at_a), len(at_b)))
        for name, (weight, kind) in parts.items():
            s, x, y = sums(a, b, name)
            if kind == "jaccard":
                every = np.bincount(x[0], minlength=len(at_a))[:, None] + np.bincount(y[0], minlength=len(at_b))[None, :] - s
                s = np.divide(s, every, out=np.zeros_like(s), where=every > 0)
            elif kind == "row_max":
                top = s.max(1) if n_t == 1 else a[a["part"] == name].set_index("pos")["top"].reindex(at_a).to_numpy()
                s = s / np.fmax(top, 1e-9)[:, None]
            total += weight * s
        order = np.broadcast_to(np.arange(len(at_b)), total.shape)
        if k is not None:
            total = half_up(total, digits)
            order = np.argsort(-total, axis=1, kind="stable")[:, :k]
            total = np.take_along_axis(total, order, 1)
        return pd.DataFrame({"src_pos": np.repeat(at_a, order.shape[1]), "tgt_pos": at_b[order].ravel(), "score": total.ravel()})

    deal = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("pos"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    meet = lambda left, f, schema: deal(left, "i", n_s, "j", n_t).groupBy("i", "j").cogroup(deal(tgt, "j", n_t, "i", n_s).groupBy("i", "j")).applyInPandas(f, schema)
    if n_t > 1:
        tops = meet(src, largest, "pos long, part string, top double").groupBy("pos", "part").agg(F.max("top").alias("top"))
        src = again(src).join(tops, ["pos", "part"], "left")
    found = meet(src, product, "src_pos long, tgt_pos long, score double")
    return found if k is None else top_k(found, k)


def tfidf_top_k(corpus: DataFrame, tokens: Column, text: Column, k: int, digits: int = 6, tile: int = 2000, terms: int = 4096) -> DataFrame:
    """(src_pos, tgt_pos, score, rank): the k target texts with the largest rounded cosine of each source text.

    Where only the best are wanted, common terms need not make a row for each pair: both sides are dealt into tiles of
    about `tile` texts, a pair of tiles is a product of two matrices, some thousand shared terms at a time, and k rows
    of a source leave it. Pairs without a shared term are left out; ties go to the smaller id.
    """
    ship(corpus.sparkSession)
    unit = tfidf_units(corpus, tokens, text)
    vectors = unit.groupBy("doc", "is_source").agg(F.collect_list(F.xxhash64("block", "term")).alias("t"), F.collect_list("w").alias("w"))
    vectors = saved(vectors, "vectors")
    sizes = {r.is_source: max(1, -(-r["count"] // tile)) for r in vectors.groupBy("is_source").count().collect()}
    n_s, n_t = sizes.get(True, 1), sizes.get(False, 1)

    def flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["t"]]), np.concatenate(list(pdf["t"])), np.concatenate(list(pdf["w"]))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"src_pos": pd.Series(dtype=object), "tgt_pos": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return none
        b = b.sort_values("doc")
        (row_a, term_a, w_a), (row_b, term_b, w_b) = flat(a), flat(b)
        scores = shared_sums((row_a, term_a, w_a), (row_b, term_b, w_b), (len(a), len(b)), terms)
        scores = np.where(scores > 0, np.round(scores, digits), -np.inf)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(scores, order, 1)
        fine = np.isfinite(got)
        names = np.repeat(a["doc"].to_numpy(), order.shape[1]).reshape(order.shape)
        return pd.DataFrame({"src_pos": names[fine], "tgt_pos": b["doc"].to_numpy()[order][fine], "score": got[fine]})

    deal = lambda df, mine, n, other, m: df.select("doc", "t", "w", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    left = deal(vectors.where("is_source"), "i", n_s, "j", n_t)
    right = deal(again(vectors).where("not is_source"), "j", n_t, "i", n_s)
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(product, "src_pos string, tgt_pos string, score double")
    return top_k(found, k)


def jaccard_by_index(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(a, b, score) of token sets from src(a, tokens), tgt(b, tokens), for the pairs that share a token."""
    one = lambda df, key: df.select(key, F.size(F.array_distinct("tokens")).alias(f"n_{key}"), F.explode(F.array_distinct("tokens")).alias("token"))
    hits = join_terms(one(src, "a"), one(tgt, "b"), ["token"], "a", "b", max(src.count(), tgt.count())).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return hits.select("a", "b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("score"))
