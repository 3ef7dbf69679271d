"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of so many words; every passage of the whole text is encoded, a gated attention
network learns from document labels alone which passages tell, and the attention-weighted mean of the passages'
representations is scored by a logistic layer (Ilse, Tomczak and Welling 2018). All of it is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, map_rows, text_of
from .glyphs import CAPITAL, CLASSES, DIGIT, LETTER, OTHER, SHOUT, STOP, SYMBOL, Block, blocks

PASSAGE_WORDS = 96
BUCKETS = 48
DENSE = 13
WIDTH = DENSE + BUCKETS


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text). A text without words is one passage of zeros."""
    b = Block(texts)
    words = np.bincount(b.text_of_word, minlength=b.n)
    counts = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    x = np.zeros((total, WIDTH))
    if len(b.starts) == 0:
        return x, counts
    passage = first[b.text_of_word] + b.number // PASSAGE_WORDS
    ends = np.append(b.starts[1:], len(b.codes))
    char_passage = np.repeat(passage, ends - b.starts)
    kinds = np.bincount(char_passage * CLASSES + b.kinds[b.starts[0] :], minlength=total * CLASSES).reshape(total, CLASSES).astype(float)
    n = np.bincount(passage, minlength=total).astype(float)
    chars = np.maximum(1.0, kinds[:, 1:].sum(1))
    letters = np.maximum(1.0, kinds[:, LETTER] + kinds[:, CAPITAL])
    key = (passage.astype(np.uint64) << np.uint64(40)) ^ (b.hashes >> np.uint64(24))
    distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(int), minlength=total)
    same = np.zeros(len(passage), bool)
    same[1:] = (b.hashes[1:] == b.hashes[:-1]) & (passage[1:] == passage[:-1])
    lengths = np.bincount(passage, weights=np.sqrt(np.add.reduceat((b.kinds != 0).astype(float), b.starts)), minlength=total)
    some = np.maximum(n, 1)
    x[:, 0] = kinds[:, SYMBOL] / chars
    x[:, 1] = kinds[:, CAPITAL] / letters
    x[:, 2] = kinds[:, SHOUT] / some
    x[:, 3] = kinds[:, STOP] / some
    x[:, 4] = kinds[:, DIGIT] / chars
    x[:, 5] = kinds[:, OTHER] / chars
    x[:, 6] = distinct / some
    x[:, 7] = np.bincount(passage, weights=same, minlength=total) / some
    x[:, 8] = lengths / some / 3
    x[:, 9] = kinds[:, SYMBOL] / some
    x[:, 10] = n / PASSAGE_WORDS
    x[:, 11] = np.log1p(words.repeat(counts)) / 8
    x[:, 12] = x[:, 6] * x[:, 10]
    bag = np.bincount(passage * BUCKETS + (b.hashes % np.uint64(BUCKETS)).astype(int), minlength=total * BUCKETS).reshape(total, BUCKETS)
    x[:, DENSE:] = np.sqrt(bag / some[:, None])
    return x, counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ w["e"] + w["eb"])
        v, u = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
        a = (v * u) @ w["a"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "v": v, "u": u, "att": a, "z": z, "bag": bag, "starts": starts, "p": sigmoid(z @ w["c"] + w["cb"])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["p"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, counts)
        bag, h, v, u, att = f["bag"], f["h"], f["v"], f["u"], f["att"]
        d = (f["p"] - y) * weight / weight.sum()
        dz = d[:, None] * w["c"]
        datt = (dz[bag] * h).sum(1)
        ds = att * (datt - np.add.reduceat(att * datt, f["starts"])[bag])
        gate = ds[:, None] * w["a"]
        dv, du = gate * u * (1 - v * v), gate * v * u * (1 - u)
        dh = att[:, None] * dz[bag] + dv @ w["v"].T + du @ w["u"].T
        de = dh * (1 - h * h)
        g = {"c": f["z"].T @ d, "cb": d.sum(keepdims=True), "a": (v * u).T @ ds, "v": h.T @ dv, "u": h.T @ du, "e": f["x"].T @ de, "eb": de.sum(0)}
        return {k: val + decay * w[k] for k, val in g.items()}


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 20, gates: int = 10, epochs: int = 14, batch: int = 96, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam over bags in a seeded order. With no labels, or labels of one kind, the model scores that share for all."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = 1 / np.maximum(x.std(0) if len(x) else np.ones(WIDTH), 0.02)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    w = {"e": init(WIDTH, hidden), "eb": np.zeros(hidden), "v": init(hidden, gates), "u": init(hidden, gates), "a": init(gates), "c": init(hidden), "cb": np.array([np.log(share / (1 - share))])}
    model = Model(mean, scale, w)
    if len(set(y.tolist())) < 2:
        w["c"][:] = 0
        return model
    starts = np.cumsum(counts) - counts
    moment = {k: np.zeros_like(p) for k, p in w.items()}
    square = {k: np.zeros_like(p) for k, p in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            n = counts[pick]
            rows = np.repeat(starts[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())
            g = model.gradients(x[rows], n, y[pick], np.ones(len(pick)), decay)
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in w:
                moment[k] += 0.1 * (g[k] - moment[k])
                square[k] += 0.001 * (g[k] ** 2 - square[k])
                w[k] -= now * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def passage_rows(batch: list[tuple]) -> Iterator[tuple]:
    texts = [t for *_, t in batch]
    for low, high in blocks(texts):
        x, counts = encode(texts[low:high])
        ends = np.cumsum(counts)
        for (key, label, _), end, n in zip(batch[low:high], ends, counts):
            yield key, label, x[end - n : end].astype("<f4").tobytes()


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, hold: int, rest: int, sample: int, longest: int, seed: int = 7) -> Model:
    """A model from at most `sample` labelled documents of at most `longest` characters, those first by a hash of the id, outside the held-out rest."""
    usable = labels.where(F.col(label).isin(0, 1) & (F.pmod(crc_of_id("doc_id"), F.lit(hold)) != rest)).groupBy(F.col("doc_id").alias("key")).agg(F.max(label).alias("label"))
    chosen = usable.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample)  # at most `sample` small rows: safe to broadcast
    known = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "key")
    known = known.where(F.char_length("text") <= longest)
    # an id that many rows share gives one text, put together on the map side
    known = known.groupBy("key", "label").agg(F.max("text").alias("text"))
    got = map_rows(known, "key long, label int, x binary", passage_rows).toPandas().sort_values(["key", "label"], ignore_index=True)
    bags = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in got["x"]]
    x = np.concatenate(bags).astype(float) if bags else np.zeros((0, WIDTH))
    return train(x, np.array([len(b) for b in bags], dtype=int), got["label"].to_numpy(dtype=float), seed=seed)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", hold: int = 3, rest: int = 1, sample: int = 4000, longest: int = 100_000) -> DataFrame:
    """Every row of docs as a struct `row`, with held_out, score and predicted.

    Labels are learned only where crc32 of the id as text modulo `hold` is not `rest`, from at most `sample`
    documents of at most `longest` characters (the bound on what comes to the driver); every passage of every whole
    text is scored. A score depends on the text alone: null is the empty text, which is one passage of zeros and is scored like others; repeated rows get equal scores; a null id is the empty text for
    the remainder. Other columns are carried, not read. An empty table gives an empty table; without labels every
    score is 0.5.
    """
    model = fit(docs, labels, id_col, text_col, label, hold, rest, sample, longest)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        whole = texts.tolist()
        parts = [model.score(*encode(whole[a:b])) for a, b in blocks(whole)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    # the filter of a later stage must not move below the model, which would score twice
    return docs.select(F.struct("*").alias("row"), (F.pmod(crc_of_id(id_col), F.lit(hold)) == rest).alias("held_out"), score(text_of(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
