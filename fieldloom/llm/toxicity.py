"""Toxicity: a convolutional text classifier with hashed word embeddings, several filter widths and max pooling.

Words are hashed into a table of embeddings; filters of one to three words slide over the whole text, each keeps its
largest value, and a logistic layer scores them. Training is numpy; max pooling sends gradients to few words only.
After it, a threshold is calibrated for each language, which is told from common words of the text itself, and the
score is shifted so that 0.5 is that threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, map_rows, text_of
from .glyphs import Block, blocks, word_hash
from .quality_mil import sigmoid

BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
#: Common words by which a text's language is told.
COMMON = {
    "en": "the of and to in is that for it with as was on be by this are from",
    "de": "der die und das von mit ist nicht den zu auf ein eine für dem des sich auch",
    "fr": "le la les de des et un une du en que qui dans pour pas sur est avec",
    "es": "el los las que y en un una con por para su del se al es como esta",
}
LANGUAGES = (*COMMON, "other")


@lru_cache(maxsize=1)
def language_of_word() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common words, and for each the languages that have it, as columns of a matrix."""
    found: dict[int, set[int]] = {}
    for i, words in enumerate(COMMON.values()):
        for w in words.split():
            found.setdefault(word_hash(w), set()).add(i)
    keys = np.array(sorted(found), dtype=np.uint64)
    return keys, np.array([[j in found[k] for j in range(len(COMMON))] for k in sorted(found)], dtype=float)


def token_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in one array with padding after each, first place of each text, language of each).

    Each place has the ids of a word and of its stem, which add up to its embedding. Id 0 is padding; a text without
    words is padding alone.
    """
    b = Block(texts)
    words = np.bincount(b.text_of_word, minlength=b.n)
    pad = max(WIDTHS)
    first = np.cumsum(words + pad) - (words + pad)
    ids = np.zeros((int((words + pad).sum()), 2), dtype=np.int32)
    votes = np.zeros((b.n, len(COMMON)))
    if len(b.starts):
        at = first[b.text_of_word] + b.number
        for side, h in enumerate((b.hashes, b.stems)):
            ids[at, side] = 1 + (h % np.uint64(BUCKETS)).astype(np.int32)
        keys, member = language_of_word()
        at = np.minimum(np.searchsorted(keys, b.hashes), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == b.hashes)
        for j in range(len(COMMON)):
            votes[:, j] = np.bincount(b.text_of_word[hit], weights=member[at[hit], j], minlength=b.n)
    return ids, first, np.where(votes.max(1) > 0, votes.argmax(1), len(COMMON))


class Model:
    """table: embeddings, row 0 is padding; kernels: dim x (slots x filters), a slot for each word of each width."""

    slots = [(w, j) for w in WIDTHS for j in range(w)]

    def __init__(self, dim: int, filters: int, seed: int):
        rng = np.random.default_rng(seed)
        self.filters = filters
        self.table = rng.normal(0, 0.1, (BUCKETS + 1, dim))
        self.table[0] = 0
        self.kernels = np.concatenate([rng.normal(0, 1 / np.sqrt(w * dim), (dim, filters)) for w, _ in self.slots], 1)
        total = filters * len(WIDTHS)
        self.bias, self.out, self.out_bias = np.zeros(total), rng.normal(0, 0.5, total), 0.0
        self.shift = np.zeros(len(LANGUAGES))  # the calibrated threshold of each language, as a logit
        self.product: np.ndarray | None = None
        self.kind = np.float32  # of what filters give

    def settle(self) -> None:
        """Keep the product of table and kernels, which no longer changes."""
        self.product = (self.table @ self.kernels).astype(self.kind)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """What every filter gives at each place, before the bias."""
        product = self.product if self.product is not None else (self.table @ self.kernels).astype(self.kind)
        parts = product[ids[:, 0]] + product[ids[:, 1]]
        f, n = self.filters, len(ids)
        out = np.zeros((n, f * len(WIDTHS)), dtype=self.kind)
        for s, (w, j) in enumerate(self.slots):
            out[: n - j, (w - 1) * f : w * f] += parts[j:, s * f : (s + 1) * f]
        out[ids[:, 0] == 0] = 0  # what begins in the padding must not reach into the next text
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled = np.maximum.reduceat(self.places(ids), first)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def score(self, texts: list[str]) -> np.ndarray:
        ids, first, lang = token_ids(texts)
        return sigmoid(self.logits(ids, first) - self.shift[lang])


def joined(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.cumsum(lengths) - lengths


def log_odds(bags: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each id how much likelier a toxic text has it, as a shrunken logarithm; rare ids are near zero."""
    seen = np.zeros((2, BUCKETS + 1))
    for b, label in zip(bags, y):
        seen[int(label), np.unique(b)] += 1
    share = (seen + 0.5) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 1)
    total = seen.sum(0)
    out = np.log(share[1] / share[0]) * total / (total + 5)
    out[0] = 0
    return out


def gradients(m: Model, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(rows of the table that have one, gradients by name) of the mean weighted logistic loss over the bags."""
    ids, first = joined(bags)
    total = m.filters * len(WIDTHS)
    values = m.places(ids)
    pooled = np.maximum.reduceat(values, first)
    text = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    act = np.maximum(pooled + m.bias, 0)
    d = (sigmoid(act @ m.out + m.out_bias) - y) * weight / len(bags)
    d_act = d[:, None] * m.out * (act > 0)
    # the first place where each filter has its largest value in each text
    at, col = np.nonzero(values == pooled[text])
    _, one = np.unique(text[at] * total + col, return_index=True)
    at, col = at[one], col[one]
    da = d_act[text[at], col]
    live = (da != 0) & (ids[at, 0] > 0)
    at, col, da = at[live], col[live], da[live]
    width, own = col // m.filters + 1, col % m.filters
    g_kernels = np.zeros_like(m.kernels)
    rows, grads = [], []
    for s, (w, j) in enumerate(m.slots):
        here = (width == w) & (at + j < len(ids))
        words, c, g = ids[at[here] + j], s * m.filters + own[here], da[here]
        np.add.at(g_kernels.T, c, g[:, None] * m.table[words].sum(1))
        for side in range(2):
            rows.append(words[:, side])
            grads.append(g[:, None] * m.kernels.T[c])
    rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    g_table = np.zeros((len(rows), m.table.shape[1]))
    np.add.at(g_table, inverse, np.concatenate(grads))
    g_table[rows == 0] = 0
    return rows, {"table": g_table, "kernels": g_kernels, "bias": d_act.sum(0), "out": act.T @ d, "out_bias": d.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, dim: int = 10, filters: int = 6, epochs: int = 4, batch: int = 48, rate: float = 0.15, seed: int = 11) -> Model:
    """Adagrad on the logistic loss, both kinds weighted alike. With labels of one kind, or none, all score 0.5.

    The first coordinate of the embeddings begins as log-odds, read by one filter: as the maximum passes gradients to
    one word of a text alone, words that mostly stand beside stronger ones would otherwise hardly be learned.
    """
    m = Model(dim, filters, seed)
    if len(set(y.tolist())) < 2:
        m.out[:] = 0
        m.settle()
        return m
    m.table[:, 0] = 0.5 * log_odds(bags, y)
    m.kernels[:, 0] = np.eye(dim)[0]
    m.bias[0], m.out[0] = -1.0, 1.0
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    seen = {k: np.full(np.shape(getattr(m, k)), 1e-2) for k in ("kernels", "bias", "out", "out_bias")}
    seen_table = np.full(m.table.shape, 1e-3)
    lengths = np.array([len(b) for b in bags])
    for _ in range(epochs):
        # neighbours in length share a batch; batches come in a new order each time
        order = np.lexsort((rng.random(len(y)), lengths // 64))
        cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
        for pick in (cuts[i] for i in rng.permutation(len(cuts))):
            rows, g = gradients(m, [bags[i] for i in pick], y[pick], weight[pick])
            seen_table[rows] += g["table"] ** 2
            m.table[rows] -= rate * g["table"] / np.sqrt(seen_table[rows])
            for name in seen:
                seen[name] += g[name] ** 2
                setattr(m, name, getattr(m, name) - rate * g[name] / np.sqrt(seen[name]))
    m.settle()
    return m


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest stretch of thresholds with the largest F1; logits at or over it are called toxic."""
    order = np.argsort(-logits, kind="stable")
    s, t = logits[order], y[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
    gaps = np.append(s[:-1] - s[1:], 1.0)
    f1 = np.where(gaps > 0, f1, -1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = top[np.argmax(gaps[top])]
    return float(s[k] - gaps[k] / 2)


def calibrate(m: Model, bags: list[np.ndarray], lang: np.ndarray, y: np.ndarray, least: int = 20) -> None:
    """Sets the shift of every language; one with under `least` documents of either kind takes the common one."""
    if len(set(y.tolist())) < 2:
        return
    logits = m.logits(*joined(bags))
    m.shift[:] = best_threshold(logits, y)
    for i in range(len(LANGUAGES)):
        own = lang == i
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            m.shift[i] = best_threshold(logits[own], y[own])


def id_rows(batch: list[tuple]) -> Iterator[tuple]:
    texts = [t for *_, t in batch]
    for low, high in blocks(texts):
        ids, first, lang = token_ids(texts[low:high])
        ends = np.append(first[1:], len(ids))
        for (key, label, _), a, b, code in zip(batch[low:high], first, ends, lang):
            yield key, label, int(code), ids[a:b].astype("<i4").tobytes()


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, hold: int, rest: int, sample: int, longest: int, seed: int = 11) -> Model:
    """A model from at most `sample` labelled documents of at most `longest` characters outside the held-out rest, half of each kind where there are enough."""
    usable = labels.where(F.col(label).isin(0, 1) & (F.pmod(crc_of_id("doc_id"), F.lit(hold)) != rest)).groupBy(F.col("doc_id").alias("key")).agg(F.max(label).alias("label"))
    pick = lambda kind: usable.where(F.col("label") == kind).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample // 2)
    chosen = pick(1).union(pick(0))  # at most `sample` small rows: safe to broadcast
    known = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "key")
    known = known.where(F.char_length("text") <= longest)
    # an id that many rows share gives one text, put together on the map side
    known = known.groupBy("key", "label").agg(F.max("text").alias("text"))
    got = map_rows(known, "key long, label int, lang int, ids binary", id_rows).toPandas().sort_values(["key", "label"], ignore_index=True)
    bags = [np.frombuffer(b, "<i4").reshape(-1, 2) for b in got["ids"]]
    y, lang = got["label"].to_numpy(dtype=float), got["lang"].to_numpy(dtype=int)
    # every fifth document calibrates and is not trained on
    part = np.arange(len(y)) % 5 == 4
    model = train([b for b, p in zip(bags, part) if not p], y[~part], seed=seed)
    calibrate(model, [b for b, p in zip(bags, part) if p], lang[part], y[part])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", hold: int = 5, rest: int = 0, sample: int = 5000, longest: int = 100_000) -> DataFrame:
    """Every row of docs as a struct `row`, with held_out, score and predicted.

    Labels are learned only where crc32 of the id as text modulo `hold` is not `rest`, from at most `sample`
    documents of at most `longest` characters (the bound on what comes to the driver); every whole text is scored. A
    score depends on the text alone, language included; null is
    the empty text, which is padding and is scored like others; repeated rows get equal scores; a null id is the empty
    text for the remainder. An empty table gives an empty table; without labels of both kinds every score is 0.5.
    """
    model = fit(docs, labels, id_col, text_col, label, hold, rest, sample, longest)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        whole = texts.tolist()
        parts = [model.score(whole[a:b]) for a, b in blocks(whole)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.select(F.struct("*").alias("row"), (F.pmod(crc_of_id(id_col), F.lit(hold)) == rest).alias("held_out"), score(text_of(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
