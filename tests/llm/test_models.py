"""The two classifiers: held-out accuracy, gradients, odd rows, scores that depend on the text alone."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import quality_mil, toxicity
from fieldloom.llm.queries import QUERIES

from .cases import ROWS, empty, odd

BIG = "/root/testdata/sf0.01"


def held_out(spark, name, label, hold, rest):
    got = QUERIES[name](spark, BIG).toPandas()
    assert sorted(got.columns) == ["doc_id", "held_out", "predicted", "score"] and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % hold == rest) for i, h in zip(got["doc_id"], got["held_out"]))
    both = got[got["held_out"]].merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas(), on="doc_id")
    return both["predicted"].to_numpy(), both[label].to_numpy()


def test_quality(spark):
    guess, truth = held_out(spark, "op4_quality_classifier", "quality", 3, 1)
    assert (guess == truth).mean() >= 0.93
    assert guess[truth == 1].mean() >= 0.97


def test_toxicity(spark):
    guess, truth = held_out(spark, "op9_toxicity", "toxic", 5, 0)
    assert guess[truth == 0].mean() <= 0.05
    assert guess[truth == 1].mean() >= 0.75


@pytest.mark.parametrize("module, label", [(quality_mil, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, sf, module, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = module.classify(odd(spark, ["score", "held_out", "predicted", "key", "label", "row"]), labels).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.row.key is None
        assert by_text.setdefault(r.row.text or "", r.score) == r.score
    assert module.classify(empty(spark), labels).count() == 0
    without = module.classify(odd(spark), labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert tuple(without) == (0.5, 0.5)


def test_scores_do_not_depend_on_neighbours():
    texts = ["a b c", "", "D E!! F", "x | y | z " * 400, "Ñandú ### 5"]
    rng = np.random.default_rng(0)
    mil = quality_mil.train(*quality_mil.encode(texts * 20), rng.integers(0, 2, 100).astype(float), epochs=1)
    cnn = toxicity.Model(6, 3, 0)
    cnn.settle()
    for score in (lambda t: mil.score(*quality_mil.encode(t)), cnn.score):
        np.testing.assert_allclose(np.concatenate([score([t]) for t in texts]), score(texts), atol=1e-6)


def test_attention_gradients():
    rng = np.random.default_rng(3)
    counts, y = np.array([2, 1, 4]), np.array([0.0, 1.0, 1.0])
    x = rng.normal(size=(7, quality_mil.WIDTH))
    m = quality_mil.train(x, counts, y, hidden=4, gates=3, epochs=1)
    loss = lambda: -np.mean(y * np.log(m.score(x, counts)) + (1 - y) * np.log(1 - m.score(x, counts)))
    for name, g in m.gradients(x, counts, y, np.ones(3), 0.0).items():
        w = m.weights[name].reshape(-1)
        for i in range(0, len(w), max(1, len(w) // 5)):
            old, eps = w[i], 1e-5
            w[i] = old + eps
            up = loss()
            w[i] = old - eps
            down = loss()
            w[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_pooling_takes_the_whole_text():
    texts = [f"{'plain words here ' * 300}{'vile' if i % 2 else 'kind'} {'and so on ' * 200}" for i in range(60)]
    ids, first, _ = toxicity.token_ids(texts)
    bags = [ids[a:b] for a, b in zip(first, [*first[1:], len(ids)])]
    y = np.arange(60) % 2 * 1.0
    m = toxicity.train(bags, y, epochs=10, batch=12)
    toxicity.calibrate(m, bags, np.zeros(60, int), y)
    assert ((m.score(texts) >= 0.5) == (y == 1)).mean() >= 0.95


def test_attention_forward_is_the_formula():
    """The score by loops over passages and units: gated attention, weighted mean, logistic layer."""
    import math

    rng = np.random.default_rng(4)
    counts = np.array([1, 3, 5])
    x = rng.normal(size=(9, quality_mil.WIDTH))
    m = quality_mil.train(x, counts, np.array([0.0, 1.0, 0.0]), hidden=5, gates=3, epochs=2)
    w, at = m.weights, 0
    for bag, n in enumerate(counts):
        hidden, attention = [], []
        for row in x[at : at + n]:
            row = [(v - a) * s for v, a, s in zip(row, m.mean, m.scale)]
            h = [math.tanh(sum(v * w["e"][i][j] for i, v in enumerate(row)) + w["eb"][j]) for j in range(5)]
            gate = [math.tanh(sum(h[i] * w["v"][i][k] for i in range(5))) / (1 + math.exp(-sum(h[i] * w["u"][i][k] for i in range(5)))) for k in range(3)]
            hidden.append(h)
            attention.append(math.exp(sum(g * a for g, a in zip(gate, w["a"]))))
        z = [sum(a * h[j] for a, h in zip(attention, hidden)) / sum(attention) for j in range(5)]
        p = 1 / (1 + math.exp(-sum(v * c for v, c in zip(z, w["c"])) - w["cb"][0]))
        assert m.score(x, counts)[bag] == pytest.approx(p, abs=1e-9)
        at += n


def small_cnn(kind=np.float64):
    rng = np.random.default_rng(8)
    m = toxicity.Model(4, 2, 3)
    m.kind = kind
    m.bias, m.out_bias = rng.normal(0, 0.3, m.bias.shape), 0.2
    bags = [np.concatenate([rng.integers(1, 40, (n, 2)), np.zeros((3, 2), int)]).astype(np.int32) for n in (1, 2, 6, 0, 9)]
    return m, bags, np.array([1.0, 0.0, 1.0, 0.0, 0.0])


def test_convolution_forward_is_the_formula():
    """Every filter at every place of every text by loops, the largest value, then the logistic layer."""
    m, bags, _ = small_cnn()
    got = m.logits(*toxicity.joined(bags))
    for bag, logit in zip(bags, got):
        words = [m.table[a] + m.table[b] for a, b in bag]
        total = m.out_bias
        for w in toxicity.WIDTHS:
            for f in range(m.filters):
                best = 0.0  # what the padding gives
                for at in range(len(bag)):
                    if bag[at][0]:
                        slots = [(m.slots.index((w, j)), j) for j in range(w)]
                        best_here = sum(float(words[at + j] @ m.kernels[:, s * m.filters + f]) for s, j in slots if at + j < len(bag))
                        best = max(best, best_here)
                k = (w - 1) * m.filters + f
                total += max(best + m.bias[k], 0) * m.out[k]
        assert logit == pytest.approx(total, abs=1e-9)


def test_convolution_gradients():
    m, bags, y = small_cnn()
    weight = np.array([0.5, 1.0, 2.0, 1.0, 0.7])

    def loss():
        p = toxicity.sigmoid(m.logits(*toxicity.joined(bags)))
        return -np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    rows, g = toxicity.gradients(m, bags, y, weight)
    assert len(rows) and 0 < np.abs(g["table"]).sum()
    places = [("out_bias", None)] + [(k, i) for k in ("kernels", "bias", "out") for i in np.ndindex(getattr(m, k).shape)] + [("table", (r, c)) for r in rows if r for c in range(4)]
    for name, i in places:
        own = g[name] if i is None else g["table"][np.flatnonzero(rows == i[0])[0], i[1]] if name == "table" else g[name][i]
        values = []
        for eps in (1e-6, -1e-6):
            old = m.out_bias if i is None else getattr(m, name)[i]
            if i is None:
                m.out_bias = old + eps
            else:
                getattr(m, name)[i] = old + eps
            values.append(loss())
            if i is None:
                m.out_bias = old
            else:
                getattr(m, name)[i] = old
        assert own == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-6), (name, i)
