"""Catalogs, matchers, metrics, calibration, assignment and training values on small cases with known results."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as X
from fieldloom.operators import assignment, calibration, lexical, matchers, pairs, ranking, stress, training
from fieldloom.plans import evaluation, report
from fieldloom.sources import catalog

A = [("src_ip", "Source IP", "string", "event.src.ip"), ("src_port", "Source Port", "integer", "event.src.port"), ("action", "Action", "string", "event.action")]
B = [("source_address", "Source Address", "string", "network.source.address"), ("source_port", "Source Port", "integer", "network.source.port"), ("security_action", "Security Action", "string", "security.action")]
PAIRS = [("src_ip", "source_address"), ("src_port", "source_port"), ("action", "security_action")]
MATRIX = [[0.9, 0.3, 0.2], [0.4, 0.8, 0.1], [0.2, 0.1, 0.7]]


def field_table(spark, rows):
    return catalog.with_optional(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, field_id string, name string, type string, path string"))


@pytest.fixture(scope="module")
def fields(spark):
    return field_table(spark, A), field_table(spark, B), spark.createDataFrame(PAIRS, "source string, target string")


def scores(spark, matrix):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "src_pos long, tgt_pos long, score double")


def truth(spark, sets):
    return spark.createDataFrame([(i, j) for i, s in enumerate(sets) for j in s], "src_pos long, tgt_pos long")


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows), encoding="utf-8")
    return str(path)


def test_catalog_scan(spark, tmp_path):
    rows = [
        {"field_id": "b", "name": "first", "type": {"base": "ip"}, "path": "x.y"},
        "",
        {"field_id": "a", "type": "string", "examples": ["u", "", 0, "v"], "desc": "d", "msg": "m"},
        {"field_id": "b", "name": "last", "description": "long", "examples": "one", "vendor_id": 7},
    ]
    got = [r.asDict() for r in catalog.read_catalog(spark, write(tmp_path / "c.jsonl", rows)).orderBy("pos").collect()]
    assert [(r["field_id"], r["pos"], r["name"], r["type"]) for r in got] == [("b", 0, "last", ""), ("a", 1, "", "string")]
    assert (got[0]["desc"], got[0]["example"], got[0]["vendor"]) == ("long", "one", "7")
    assert (got[1]["example"], got[1]["desc"], got[1]["raw_msg"]) == ("u v", "d", "m")
    with pytest.raises(Exception, match="field_id|MALFORMED|Malformed"):
        catalog.read_catalog(spark, write(tmp_path / "bad.jsonl", [{"name": "x"}])).collect()


def test_pairs(spark, tmp_path, fields):
    src, tgt, _ = fields
    rows = [{"source": "src_ip", "target": "source_address", "label": 1}, {"source": "src_ip", "target": "source_port", "label": 0}, {"source": "action", "target": "nowhere"}, {"source": "src_ip", "target": "source_address"}]
    table = catalog.read_pairs(spark, write(tmp_path / "p.jsonl", rows))
    assert table.count() == 3
    t = pairs.truth(table, src, tgt)
    assert [tuple(r) for r in t.collect()] == [(0, 0)]
    assert [(r.src_pos, r.targets, r.first_target) for r in pairs.truth_sets(t, src).orderBy("src_pos").collect()] == [(0, [0], 0), (1, [], -1), (2, [], -1)]
    stats = pairs.dataset_stats(table, src, tgt).first()
    assert (stats.n_gold_pairs, stats.n_sources_with_gt, stats.max_targets_per_source) == (3, 1, 1)
    texts = catalog.paired_texts(table, src.withColumn("text", F.col("name")), tgt.withColumn("text", F.col("name"))).collect()
    assert ("Action", "") in {(r.text_a, r.text_b) for r in texts}


@pytest.mark.parametrize(
    "lines, want",
    [
        (["name,type,path", "Source IP,ip,event.src.ip"], ["[NAME] Source IP [TYPE] ip [PATH] event . src . ip"]),
        (["﻿Name,Description,PATH", "a,d,p.q"], ["[NAME] a [PATH] p . q"]),
        (["Dest Port,integer,event.dst.port"], ["[NAME] Dest Port [TYPE] integer [PATH] event . dst . port"]),
        (["a,what it is,p.q,ip", "b,d,r,port,80"], ["[NAME] a [TYPE] ip [PATH] p . q", "[NAME] b [TYPE] port [PATH] r"]),
        (["just a line"], ["just a line"]),
    ],
)
def test_training_lines(spark, tmp_path, lines, want):
    got = catalog.read_training_lines(spark, write(tmp_path / "t.csv", lines)).orderBy("line_no").collect()
    assert [r.text for r in got] == want


def test_training_line_modes(spark, tmp_path):
    assert catalog.read_training_lines(spark, str(tmp_path / "none.csv")).count() == 0
    path = write(tmp_path / "r.csv", ["<13> tag: the message", "no tag here"])
    assert sorted(r.text for r in catalog.read_training_lines(spark, path, "raw_msg").collect()) == ["no tag here", "the message"]
    twice = catalog.read_training_lines(spark, path, multiplier=2)
    assert twice.count() == 4 and catalog.distinct_texts(twice).count() == 2
    assert catalog.looks_like_header("example text", strict=False) and not catalog.looks_like_header("example text")


def test_all_pairs_in_blocks(spark, fields):
    src, tgt, _ = fields
    want = {(i, j) for i in range(3) for j in range(3)}
    for limit in (1, 2, 100):
        got = pairs.all_pairs(src, tgt, limit).select("src_pos", "tgt_pos").collect()
        assert len(got) == 9 and {tuple(r) for r in got} == want


@pytest.mark.parametrize(
    "matrix, sets, ranks, hit1, hit3, mrr",
    [
        (MATRIX, [{0}, {1}, {2}], [1, 1, 1], 1, 1, 1),
        (MATRIX, [{0}, {1}, {0, 2}], [1, 1, 1], 1, 1, 1),
        (MATRIX, [{1}, {0}, {1}], [2, 2, 3], 0, 1, (1 / 2 + 1 / 2 + 1 / 3) / 3),
        ([[0.5, 0.5, 0.5]], [{2}], [3], 0, 1, 1 / 3),
        (MATRIX, [{0}, set(), {1}], [1, 3], 0.5, 1, 2 / 3),
    ],
)
def test_metrics(spark, matrix, sets, ranks, hit1, hit3, mrr):
    s, t = scores(spark, matrix), truth(spark, sets)
    assert [r.rank for r in ranking.best_ranks(s, t).orderBy("src_pos").collect()] == ranks
    row = ranking.metrics(s, t).first()
    assert (row.hit_at_1, row.hit_at_3, row.mrr) == (pytest.approx(hit1), pytest.approx(hit3), pytest.approx(mrr, abs=1e-6))
    gain = lambda order, rel, k: sum(1 / math.log2(i + 2) for i, j in enumerate(order[:k]) if j in rel) / sum(1 / math.log2(i + 2) for i in range(min(k, len(rel))))
    orders = [sorted(range(len(m)), key=lambda j, m=m: (-m[j], j)) for m in matrix]
    want = np.mean([gain(o, r, 3) for o, r in zip(orders, sets) if r])
    assert row.ndcg_at_3 == pytest.approx(want, abs=1e-6)
    e = ranking.Evaluator(s, t)
    assert e.hit_at(1) == pytest.approx(hit1) and e.mrr() == pytest.approx(mrr)


def test_ranking_extras(spark):
    s, t = scores(spark, MATRIX), truth(spark, [{0}, {1}, {2}])
    assert ranking.top1_margin(s).first()[0] == pytest.approx(0.5)
    assert tuple(ranking.candidate_stats(s).first()) == (3.0, 3, 3)
    p = ranking.softmax(s, 0.5)
    assert all(r[0] == pytest.approx(1) for r in p.groupBy("src_pos").agg(F.sum("prob")).select("sum(prob)").collect())
    assert ranking.looks_like_probabilities(p.withColumn("score", F.col("prob"))).first()[0] is True
    assert ranking.looks_like_probabilities(s).first()[0] is False
    with pytest.raises(ValueError):
        ranking.softmax(s, 0)
    assert ranking.random_hit1(s, t).first()[0] == 1
    assert {r.tgt_pos for r in ranking.top_k(s, 1).collect()} == {0, 1, 2}
    assert ranking.metrics(s.limit(0), t).first().n_eval == 0
    assert ranking.row_max_normalized(s).agg(F.min("score")).first()[0] == pytest.approx(0.1 / 0.8)
    best = spark.createDataFrame([("m", 0, 0.5, 0.0, 0.9), ("md", 1, 0.5, 0.2, 0.1), ("mdv", 2, 0.5, 0.2, 0.1)], "model string, ord int, hit_at_1 double, mrr double, ndcg_at_5 double")
    assert ranking.choose_best(best).first().model == "md"


def test_bootstrap_covers_the_mean(spark):
    values = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(80)], "i long, value double")
    low, high = ranking.bootstrap_ci(values, 300).first()
    assert low < 0.25 < high and high - low < 0.4


def brute_ece(conf, acc, n, left=False):
    total = 0.0
    for b in range(n):
        inside = [(c, a) for c, a in zip(conf, acc) if ((b / n <= c < (b + 1) / n) if left else (b / n < c <= (b + 1) / n))]
        if inside:
            total += len(inside) / len(conf) * abs(sum(a for _, a in inside) - sum(c for c, _ in inside)) / len(inside)
    return total


def test_ece(spark):
    rng = random.Random(2)
    conf = [0.0, 1.0, *[rng.random() for _ in range(60)]]
    acc = [float(rng.random() < c) for c in conf]
    tops = spark.createDataFrame(list(zip(conf, acc)), "conf double, correct double")
    assert calibration.ece(tops, 15).first()[0] == pytest.approx(brute_ece(conf, acc, 15), abs=1e-6)
    assert calibration.ece(tops, 15, calibration.lower_bin).first()[0] == pytest.approx(brute_ece(conf, acc, 15, True), abs=1e-6)


def test_isotonic(spark):
    rng = random.Random(5)
    conf = [round(rng.random(), 2) for _ in range(150)]
    acc = [float(rng.random() < c) for c in conf]
    tops = spark.createDataFrame(list(zip(conf, acc)), "conf double, correct double")
    model = calibration.fit_isotonic(tops)
    fitted = dict(tuple(r) for r in calibration.predict(model, tops.select("conf").distinct()).select("conf", "fitted").collect())
    xs = sorted(fitted)
    assert all(fitted[a] <= fitted[b] + 1e-12 for a, b in itertools.pairwise(xs))
    groups = {x: [a for c, a in zip(conf, acc) if c == x] for x in xs}
    for k, x in enumerate(xs):
        mean = lambda i, j: sum(map(sum, map(groups.get, xs[i : j + 1]))) / sum(len(groups[y]) for y in xs[i : j + 1])
        assert fitted[x] == pytest.approx(max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)))
    probs = ranking.softmax(scores(spark, [[5.0, 0, 0], [1.0, 0.9, 0.8]]))
    after = calibration.apply_isotonic(probs, model)
    assert all(r[0] == pytest.approx(1) for r in after.groupBy("src_pos").agg(F.sum("prob").alias("s")).select("s").collect())
    assert calibration.fit_temperature(scores(spark, MATRIX), truth(spark, [{0}, {1}, {2}])) == 0.05


def test_temperature_of_records(spark):
    """The likelihoods of all sources, worked out on their records; sources of a record differ in their truth."""
    rng = np.random.default_rng(8)
    table = rng.random((4, 6)).round(2).tolist()
    of = [0, 0, 0, 1, 1, 2, 3]  # the record of each source
    sets = [{0}, {0}, {1, 2}, {5}, set(), {3}, {9}]  # one has no truth, one a target that is not scored
    losses = {}
    grid = (0.05, 0.2, 1.0, 5.0)
    for tau in grid:
        p = [np.exp((np.array(table[r]) - max(table[r])) / tau) for r in of]
        losses[tau] = np.mean([-math.log(q[list(s)].sum() / q.sum()) for q, s in zip(p, sets) if s and max(s) < 6])
    want = min(losses, key=losses.get)
    known = truth(spark, sets)
    members = spark.createDataFrame(list(enumerate(of)), "src_pos long, record long")
    assert calibration.fit_temperature(scores(spark, [table[r] for r in of]), known, grid) == want
    assert calibration.fit_temperature(scores(spark, table), known, grid, members) == want
    with pytest.raises(ValueError):
        calibration.fit_temperature(scores(spark, table), known, (0.0, 1.0))
    assert calibration.fit_temperature(scores(spark, table), known.limit(0), grid) == 0.05


def test_split(spark):
    table = spark.createDataFrame([(f"s{i % 10}", f"t{i}") for i in range(30)], "source string, target string")
    for like_python in (False, True):
        got = pairs.split_by_source(table, 0.2, 42, like_python).collect()
        calib = {r.source for r in got if r.part == "calib"}
        assert len(got) == 30 and len(calib) == 2 and not calib & {r.source for r in got if r.part == "eval"}
    order = sorted({f"s{i}" for i in range(10)})
    random.Random(42).shuffle(order)
    assert calib == set(order[:2])
    assert {r.part for r in pairs.split_by_source(table.where("source = 's1'")).collect()} == {"eval"}


@pytest.mark.parametrize("seed", range(4))
def test_assignment(spark, seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
    cost = rng.integers(0, 9, (n, m)).astype(float)
    at = assignment.solve(cost)
    used = at[at >= 0]
    assert len(set(used)) == len(used) == min(n, m)
    small, large = (n, m) if n <= m else (m, n)
    table = cost if n <= m else cost.T
    best = min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert sum(cost[i, j] for i, j in enumerate(at) if j >= 0) == pytest.approx(best)


def test_assignment_threshold(spark):
    s = scores(spark, [[0.9, 0.8], [0.85, 0.1], [0.2, 0.3]])
    assert {tuple(r) for r in assignment.assign(s).collect()} == {(0, 1), (1, 0), (2, -1)}
    assert {tuple(r) for r in assignment.assign(s, tau=0.5).collect()} == {(0, 1), (1, 0), (2, -1)}
    row = assignment.assignment_accuracy(assignment.assign(s, tau=0.5), truth(spark, [{1}, {1}, {0}])).first()
    assert (row.accuracy, row.coverage) == (0.5, pytest.approx(2 / 3, abs=1e-6))
    with pytest.raises(ValueError):
        assignment.assign(s, most_pairs=3)


def brute_bm25(queries, docs, k1=1.5, b=0.75):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    sets = list(map(set, docs))
    df = {w: sum(w in s for s in sets) for w in set().union(*sets)}
    return [[sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / (avg + 1e-9))) for w in q if w in d) for d in docs] for q in queries]


def test_bm25_over_rich_tokens(spark, fields):
    src, tgt, _ = fields
    q = matchers.sparse_catalog(src).select(F.col("pos").alias("src_pos"), X.bm25_tokens("full").alias("tokens")).persist()
    d = matchers.sparse_catalog(tgt).select(F.col("pos").alias("tgt_pos"), X.bm25_tokens("full").alias("tokens")).persist()
    want = brute_bm25([r.tokens for r in q.orderBy("src_pos").collect()], [r.tokens for r in d.orderBy("tgt_pos").collect()])
    got = {(r.src_pos, r.tgt_pos): r.score for r in lexical.bm25(q, d).collect()}
    for i, j in itertools.product(range(3), range(3)):
        assert got.get((i, j), 0.0) == pytest.approx(want[i][j])


def brute_tfidf(texts, tokens):
    def char(text):
        out = []
        for w in text.split():
            w = f" {w} "
            for n in range(2, 7):
                out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
                if len(w) <= n:
                    break
        return out

    def block(docs, max_df):
        n = len(docs)
        df = {t: sum(t in d for d in docs) for d in docs for t in d}
        rows = [{t: (1 + math.log(d.count(t))) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(d) if df[t] <= max_df * n} for d in docs]
        return [{t: w / (math.sqrt(sum(x * x for x in r.values())) or 1) for t, w in r.items()} for r in rows]

    word = block([[*t, *map(" ".join, zip(t, t[1:]))] for t in tokens], 0.98)
    both = [{("c", k): v for k, v in c.items()} | {("w", k): v for k, v in w.items()} for c, w in zip(block([char(t) for t in texts], 0.95), word)]
    unit = [{k: v / (math.sqrt(sum(x * x for x in r.values())) or 1) for k, v in r.items()} for r in both]
    return lambda i, j: sum(v * unit[j].get(k, 0) for k, v in unit[i].items())


def test_tfidf_over_rich_tokens(spark, fields):
    src, tgt, _ = fields
    s, t = matchers.sparse_catalog(src), matchers.sparse_catalog(tgt)
    rows = [r for df in (s, t) for r in df.select("full", X.rich_tokens("full").alias("tok")).orderBy("pos").collect()]
    cosine = brute_tfidf([r.full for r in rows], [r.tok for r in rows])
    got = {(r.a, r.b): r.score for r in matchers.tfidf_part(s, t, True).collect()}
    for i, j in itertools.product(range(3), range(3)):
        assert got.get((f"s{i}", f"t{j}"), 0.0) == pytest.approx(cosine(i, 3 + j))


def test_half_up_rounds_as_spark_does(spark):
    x = [0.0046875, 0.0000005, 0.1234565, 0.7234565, 2.5e-7, 0.30000049999999996, 1.0, 0.0, -0.0000015, *np.random.default_rng(2).random(500), *(np.arange(1, 400) / 1280 * 0.3)]
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert lexical.half_up(np.array(x)).tolist() == want


def copied(src, times):
    """A catalog with every record several times, at other positions."""
    n = src.count()
    return src.crossJoin(src.sparkSession.range(times)).withColumn("pos", F.col("pos") + n * F.col("id")).drop("id")


@pytest.mark.parametrize("name", ["tfidf", "bm25"])
def test_ensembles_score_a_record_once(spark, fields, name):
    """Copies of a source have its scores, statistics count them, and the best targets are those of all scores."""
    src, tgt, _ = fields
    some = copied(src, 3)
    match = {"tfidf": matchers.tfidf_ensemble, "bm25": matchers.bm25_ensemble}[name]
    got = {(r.src_pos, r.tgt_pos): r.score for r in match(some, tgt).collect()}
    assert len(got) == 27
    s, t = matchers.sparse_catalog(some), matchers.sparse_catalog(tgt)
    parts = {"overlap": (matchers.token_overlap(s, t, "full", True), "full"), "path_overlap": (matchers.token_overlap(s, t, "path", True), "path"), "type_score": (matchers.same_types(s, t), "tbase")}
    if name == "tfidf":
        named = lambda df, tag: df.withColumn("doc", F.concat(F.lit(tag), F.col("pos").cast("string")))
        parts["sparse"], s, t = (matchers.tfidf_part(s, t, True), "doc"), named(s, "s"), named(t, "t")
        weights = {"sparse": 0.55, "overlap": 0.15, "path_overlap": 0.15, "type_score": 0.15}
    else:
        for part, key in (("full_bm", "full"), ("name_bm", "name"), ("path_bm", "raw_path")):
            raw = lexical.bm25(s.select(F.col("pos").alias("src_pos"), X.bm25_tokens(key).alias("tokens")), t.select(F.col("pos").alias("tgt_pos"), X.bm25_tokens(key).alias("tokens")))
            parts[part] = ranking.row_max_normalized(raw).select(F.col("src_pos").alias("a"), F.col("tgt_pos").alias("b"), "score"), "pos"
        weights = {"full_bm": 0.40, "name_bm": 0.20, "path_bm": 0.10, "overlap": 0.15, "path_overlap": 0.05, "type_score": 0.10}
    rows = matchers.filled(s, t, {n: p for n, (p, _) in parts.items()}, {n: key for n, (_, key) in parts.items()}).collect()
    for r in rows:
        assert got[r.src_pos, r.tgt_pos] == pytest.approx(sum(w * r[part] for part, w in weights.items()))
    best = {(r.src_pos, r["rank"]): (r.tgt_pos, r.score) for r in match(some, tgt, k=2).collect()}
    assert len(best) == 18
    for i in range(9):
        order = sorted((-round(got[i, j], 6), j) for j in range(3))[:2]
        assert [best[i, 1], best[i, 2]] == [(j, -v) for v, j in order]


def test_tiles_of_records(spark):
    """Several tiles give what one gives, the largest of a row among all of them; a record without terms has 0."""
    rng = np.random.default_rng(5)
    side = lambda n: spark.createDataFrame([(i, part, rng.integers(0, 12, i % 5).tolist(), None if part != "m" else rng.random(i % 5).tolist()) for i in range(n) for part in "smj"], "pos long, part string, t array<long>, w array<double>")
    parts = {"s": (0.5, "sum"), "m": (0.3, "row_max"), "j": (0.2, "jaccard")}
    from fieldloom.shared import saved

    a, b = (saved(side(n).withColumn("t", F.when(F.col("part") == "j", F.array_distinct("t")).otherwise(F.col("t"))), "side") for n in (20, 17))
    table = lambda df: {(r.src_pos, r.tgt_pos): r.score for r in df.collect()}
    one, many = table(lexical.tile_scores(a, b, parts)), table(lexical.tile_scores(a, b, parts, tile=4))
    assert len(one) == 340 and one.keys() == many.keys() and all(many[x] == pytest.approx(v) for x, v in one.items())
    best = lexical.tile_scores(a, b, parts, k=3, tile=4).collect()
    assert {(r.src_pos, r["rank"]): r.tgt_pos for r in best} == {(i, k + 1): j for i in range(20) for k, (_, j) in enumerate(sorted((-round(one[i, j], 6), j) for j in range(17))[:3])}


@pytest.mark.parametrize("name", sorted(matchers.MATCHERS.keys() - matchers.ENCODERS.keys()))
def test_every_matcher_finds_the_pairs(spark, fields, name):
    src, tgt, table = fields
    got = matchers.score(name, src, tgt)
    assert got.columns == ["src_pos", "tgt_pos", "score"] and got.count() == 9
    row = ranking.metrics(got, pairs.truth(table, src, tgt)).first()
    assert row.n_eval == 3 and row.hit_at_3 == 1
    with pytest.raises(ValueError):
        matchers.score("none", src, tgt)


def test_rules_by_hand(spark):
    a = field_table(spark, [("1", "port", "port", "a.b"), ("2", "source", "string", "x"), ("3", "zzzz", "ip", "p.q")])
    b = field_table(spark, [("1", "port", "port", "a.b"), ("2", "destination", "string", "x"), ("3", "yyyy", "ip", "p.q")])
    heur = {(r.src_pos, r.tgt_pos): r.score for r in matchers.rule_heuristic(a, b).collect()}
    assert (heur[0, 0], heur[1, 1], heur[2, 2], heur[0, 1]) == (0.28, 0.001, 0.001, 0.0)
    rich = {(r.src_pos, r.tgt_pos): r.score for r in matchers.rule_enhanced(a, b).collect()}
    assert rich[0, 0] == pytest.approx(0.78 * (0.095 + 0.012 + 0.035 + 0.012 + 0.008 + 0.0015 + 0.006) + 0.10 * (0.06 + 0.01 + 0.01))
    assert rich[1, 1] == pytest.approx(0.10 * (0.010 + 0.010))  # opposite polarity leaves the support alone
    assert matchers.rule_scores(a, b, "weak").count() == 9


def test_dense_and_constrained(spark, fields):
    src, tgt, table = fields
    embed = lambda c, role: c.withColumn("embedding", matchers.md5_embedding(F.col("name")))
    got = matchers.dense(embed)(src, tgt)
    same = {(r.src_pos, r.tgt_pos): r.score for r in got.collect()}
    assert same[1, 1] == pytest.approx(1) and len(same) == 9
    both = {(r.src_pos, r.tgt_pos): r.score for r in matchers.constrained(got, src, tgt).collect()}
    assert both[1, 1] == pytest.approx((1 + 0.3 * 1 + 0.2 * (1 / 5) + 0.1 * 1) / 1.6)


@pytest.mark.parametrize("tile", [2, 5, 100])
def test_dense_top_k(spark, tile):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 5))
    x[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, embedding array<double>")
    norm = np.linalg.norm(x, axis=1)
    cos = np.round(np.divide(x @ x.T, norm[:, None] * norm[None], out=np.zeros((9, 9)), where=norm[:, None] * norm[None] > 0), 6)
    for other, skip in ((df, True), (df.select("*"), False)):
        got = sorted((r.src_pos, r.rank, r.tgt_pos, round(r.score, 6)) for r in matchers.dense_top_k(df, other, 3, tile=tile).collect())
        want = sorted((i, n + 1, j, round(cos[i, j], 6)) for i in range(9) for n, j in enumerate(sorted((j for j in range(9) if not skip or j != i), key=lambda j, i=i: (-cos[i, j], j))[:3]))
        assert got == want


def test_stress_and_modes(spark, fields, tmp_path):
    src, tgt, table = fields
    t = pairs.truth(table, src, tgt)
    rows = {r.setting: r for r in stress.stress(src, tgt, t, matchers.overlap_matcher).collect()}
    assert set(rows) == set(stress.SETTINGS) and rows["Original"].n_eval == 3
    keys = lambda rows: [dict(zip(("field_id", "name", "type", "path"), r)) for r in rows]
    files = write(tmp_path / "a.jsonl", keys(A)), write(tmp_path / "b.jsonl", keys(B)), write(tmp_path / "p.jsonl", [{"source": a, "target": b} for a, b in PAIRS])
    out = evaluation.run(spark, *files, "single", "overlap", constrain=True, calibrate=True, assign=True)
    assert out["n_eval"] == 2 and {"ece", "ece_after", "assign_accuracy", "timing_sec"} <= out.keys()
    assert evaluation.run(spark, *files, "dataset_stats")["n_gold_pairs"] == 3
    assert set(evaluation.run(spark, *files, "table3")) == {"name", "type", "path", "weighted"}
    assert evaluation.run(spark, *files, "latency", "overlap")["ms_per_source"] > 0
    assert "ece_before" in evaluation.run(spark, *files, "table4", "overlap")
    with pytest.raises(ValueError):
        evaluation.run(spark, *files, "other")
    table = report.text_table("T", [{"m": "x", "hit_at_1": 0.5, "mrr": 0.25}, {"m": "y"}])
    assert "50.0%" in table and "0.2500" in table and "N/A" in table
    config = catalog.RunConfig(ece_bins=7)
    config.write(str(tmp_path))
    assert catalog.RunConfig.read(str(tmp_path)) == config and catalog.RunConfig.read(str(tmp_path / "no")).ece_bins == 15


def test_loss_values(spark):
    rng = np.random.default_rng(0)
    z1, z2 = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    views = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(z1, z2))], "i long, z1 array<double>, z2 array<double>")
    z = np.concatenate([z1, z2])
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    sim = np.clip(np.where(np.eye(10), -np.inf, u @ u.T / 0.05), -20, 20)
    want = np.mean(np.log(np.exp(sim).sum(1)) - sim[np.arange(10), [*range(5, 10), *range(5)]])
    assert training.nt_xent(views).first()[0] == pytest.approx(want, abs=1e-5)
    assert training.nt_xent(views.limit(1)).first()[0] == 0
    std = np.sqrt(z.var(0) + 1e-4)
    cov = np.cov(z.T)
    v, c = np.maximum(1 - std, 0).mean(), (cov[~np.eye(4, dtype=bool)] ** 2).mean()
    assert training.varclr(views, cov_weight=0.25).first()[0] == pytest.approx(v + 0.25 * 10 / 32 * c, abs=1e-5)
    rows = views.select(F.col("z1").alias("student"), F.col("z2").alias("teacher"), (F.col("i") % 2 == 0).alias("changed"))
    per = 1 - (u[:5] * u[5:]).sum(1)
    assert training.teacher_anchor(rows, 1.0).first()[0] == pytest.approx((per * [1, 0.15, 1, 0.15, 1]).mean() * 0.65, abs=1e-5)
    assert [training.varclr_weight(0.1, e, 2, 4) for e in (1, 2, 3, 9)] == [0.0, 0.025, 0.05, 0.1]


@pytest.mark.parametrize("tile, block", [(3, 2), (16_384, 1024)])
def test_contrastive_loss_of_odd_vectors(spark, tile, block):
    """Figures of a plain product of all rows; null and mixed vectors, one of zeros, ids that are null or stand twice."""
    nan = float("nan")
    cases = [
        ([], 0.0),
        ([(1, [1.0, 2.0], [2.0, 1.0]), (2, None, [1.0, 0.0]), (3, [0.0, 1.0], [1.0, 1.0])], 3.818401),
        ([(1, [0.0, 0.0], None), (2, [1.0, 1.0], [1.0, 0.0])], 3.205012),
        ([(1, [nan, 0.0], [2.0, 1.0]), (2, [1.0, 1.0], [1.0, 0.0])], 3.407784),
        ([(1, [1.0, 0.0, 2.0], [2.0, 1.0, 1.0]), (2, [1.0, 1.0], [1.0, 0.0]), (3, [], [1.0])], 8.316495),
        ([(1, [1.0, 0.0], [2.0, 1.0]), (1, [1.0, 1.0], [1.0, 0.0]), (2, [3.0, 1.0], [1.0, 5.0])], -20.756483),
        ([(None, [1.0, 0.0], [2.0, 1.0]), (None, [1.0, 1.0], [1.0, 0.0]), (2, [3.0, 1.0], [1.0, 5.0])], 15.072443),
    ]
    for rows, want in cases:
        views = spark.createDataFrame(rows, "i long, z1 array<double>, z2 array<double>")
        assert training.nt_xent(views, tile=tile, block=block).first()[0] == want


def test_contrastive_loss_makes_no_row_for_a_pair(spark):
    """6,000 vectors, over a million and a half pairs a second on one core, would take minutes pair by pair."""
    views = spark.range(3000).select(F.col("id").alias("i"), *[F.array(*[F.sin(F.col("id") + k * n) for k in range(1, 9)]).alias(f"z{n}") for n in (1, 2)])
    z = np.array([[np.sin(k * n + i) for k in range(1, 9)] for n in (1, 2) for i in range(3000)])
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    sim = np.clip(u @ u.T / 0.05, -20, 20)
    np.fill_diagonal(sim, -20)
    want = np.mean(np.log(np.exp(sim).sum(1)) - sim[np.arange(6000), [*range(3000, 6000), *range(3000)]])
    assert training.nt_xent(views).first()[0] == pytest.approx(want, abs=2e-6)
    plan = training.nt_xent(views)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_views(spark):
    texts = [f"[NAME] source ip{i} user session [TYPE] ip [PATH] a . b{i}" for i in range(200)] + ["[NAME] ip [TYPE] ip [PATH] a", "no tags", "[NAME] extraordinarily [TYPE] x [PATH] y"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no long, text string")
    for got, most in ((training.contrastive_views(lines).collect(), 4), (training.varclr_views(lines, progress=1.0).collect(), 2)):
        changed = [r for r in got if r.view != r.text]
        assert 20 < len(changed) < 200
        for r in changed:
            assert r.view.split(" [TYPE]")[-1] == r.text.split(" [TYPE]")[-1]
        assert {r.text: r.view for r in got}["no tags"] == "no tags"
        assert {r.text: r.view for r in got}["[NAME] ip [TYPE] ip [PATH] a"] == "[NAME] ip [TYPE] ip [PATH] a"
    batches = training.mini_batches(lines, 50).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in batches) == [(i, 50) for i in range(4)]
    assert training.mini_batches(lines.limit(7), 50).count() == 7


def test_streaming(spark, fields, tmp_path):
    from fieldloom.streaming.scoring import score_each_batch, stream_top_k

    src, tgt, _ = fields
    src.select("field_id", "name", "type", "path", "desc", "example", "raw_msg").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = stream_top_k(stream, tgt, 2).writeStream.format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination()
    best = {r.field_id: [b.field_id for b in r.best] for r in spark.table("best").collect()}
    assert len(best) == 3 and all(len(b) == 2 for b in best.values()) and best["src_port"][0] == "source_port"
    seen = []
    q = score_each_batch(stream, tgt, "rule", lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"), 1)
    q.awaitTermination()
    assert {r.field_id for r in seen} == {"src_ip", "src_port", "action"}


def test_stream_scores_equal_the_columns(spark, monkeypatch):
    """Best targets as Spark's own expressions rank them, with null and empty values, ties and records that come again;
    the catalog does not stand beside each row."""
    from fieldloom.functions import similarity as S
    from fieldloom.streaming import scoring

    monkeypatch.setattr(scoring, "KEPT", 5)
    words = ["red", "cold", "Ring", "bolt x", "", None, "a.b c"]
    kinds = ["ip", "STRING", '{"base": "ip"}', "", None]
    rows = lambda n, p: [(str(i), words[i * p % 7], kinds[i // 2 % 5], f"x.{words[i % 7]}.{i % 3}" if i % 4 else None) for i in range(n)]
    schema = "field_id string, name string, type string, path string"
    fields = spark.createDataFrame(rows(40, 1) + rows(40, 1), schema).withColumn("note", F.lit("kept"))
    targets = spark.createDataFrame([(i, *r) for i, r in enumerate(rows(23, 3))], "pos long, " + schema)
    got = scoring.stream_top_k(fields, targets, 4)
    assert got.columns == [*fields.columns, "best"] and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    both = lambda df, p: df.select(F.col("field_id").alias(f"{p}_id"), *([F.col("pos")] if p == "t" else []), X.plain_tokens("name").alias(f"{p}n"), X.type_base("type").alias(f"{p}t"), X.path_tokens("path").alias(f"{p}p"))
    score = F.round(matchers.weighted(S.jaccard(F.col("sn"), F.col("tn")), ((F.col("st") == F.col("tt")) & (F.col("st") != "")).cast("double"), S.jaccard(F.col("sp"), F.col("tp")), 0.3, 0.5, 0.2), 6)
    want = {}
    for r in both(fields.limit(40), "s").crossJoin(both(targets, "t")).select("s_id", "t_id", "pos", score.alias("score")).collect():
        want.setdefault(r.s_id, []).append((-r.score, r.pos, r.t_id))
    found = got.collect()
    assert len(found) == 80
    for r in found:
        assert [(b.score, b.field_id) for b in r.best] == [(-s, i) for s, _, i in sorted(want[r.field_id])[:4]]
    assert [len(r.best) for r in scoring.stream_top_k(fields.limit(2), targets.limit(0), 4).collect()] == [0, 0]


def brute_ranks(rows, sets, ks=(3, 5)):
    """{source: (best rank, ndcg...)} by sorting, ties to the smaller position."""
    out = {}
    for i, targets in sets.items():
        order = [j for _, j in sorted((-s, j) for a, j, s in rows if a == i)]
        hits = [order.index(j) + 1 for j in targets if j in order]
        if hits:
            gain = lambda k: sum(1 / math.log2(r + 1) for r in hits if r <= k) / sum(1 / math.log2(r + 1) for r in range(1, min(k, len(hits)) + 1))
            out[i] = (min(hits), *[round(gain(k), 9) for k in ks])
    return out


def test_ranks_without_sorting(spark):
    rng = random.Random(11)
    rows = [(i, j, rng.randrange(8) / 4, -float(j)) for i in range(12) for j in range(30)]
    sets = {i: set(rng.sample(range(32), rng.randrange(9))) for i in range(11)}
    table = spark.createDataFrame(rows, "src_pos long, tgt_pos long, one double, two double")
    known = spark.createDataFrame([(i, j) for i, s in sets.items() for j in s], "src_pos long, tgt_pos long")
    got = ranking.per_source_of(table, known, ["one", "two"]).collect()
    for c, name in ((2, "one"), (3, "two")):
        assert {r.src_pos: (r.rank, round(r.ndcg3, 9), round(r.ndcg5, 9)) for r in got if r.setting == name} == brute_ranks([(r[0], r[1], r[c]) for r in rows], sets)
    assert ranking.per_source_of(table, known.limit(0), ["one"]).count() == 0


def test_stress_in_one_product(spark, fields):
    """The flagship's settings as columns give what one run for each setting gives."""
    src, tgt, pair_table = fields
    known = pairs.truth(pair_table, src, tgt)
    once = {r.setting: r for r in stress.stress(src, tgt, known, matchers.overlap_matcher).collect()}
    assert once == {r.setting: r for r in stress.stress(src, tgt, known, lambda a, b: matchers.overlap_matcher(a, b)).collect()}
    assert once.keys() == stress.SETTINGS.keys()


def test_products_in_blocks(spark):
    a, b = spark.range(23).selectExpr("id as pos"), spark.range(17).selectExpr("id as pos")
    for limit in (100, 17, 5, 1):
        assert sorted(map(tuple, pairs.all_pairs(a, b, limit).collect())) == sorted(itertools.product(range(23), range(17)))


def test_common_terms_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    a = spark.createDataFrame([(i, t) for i in range(40) for t in rng.sample("abcdefgh", 3) + ["the"]], "a long, t string")
    b = spark.createDataFrame([(i, t) for i in range(50) for t in rng.sample("abcdefgh", 2) + ["the"]], "b long, t string")
    want = sorted(map(tuple, a.join(b, "t").select("a", "b", "t").collect()))
    monkeypatch.setattr(lexical, "POSTINGS", 7)
    assert sorted(map(tuple, lexical.join_terms(a, b, ["t"], "a", "b", 50).select("a", "b", "t").collect())) == want


def test_assignment_by_parts(spark):
    """With a threshold each connected part is solved alone; the total is that of one problem over all pairs."""
    rng = np.random.default_rng(6)
    m = np.where(rng.random((14, 11)) < 0.25, rng.integers(1, 30, (14, 11)) / 30, 0.0)
    tau = 0.3
    got = {r.src_pos: r.tgt_pos for r in assignment.assign(scores(spark, m.tolist()), tau).collect()}
    used = [j for j in got.values() if j >= 0]
    assert got.keys() == set(range(14)) and len(used) == len(set(used)) and all(m[i, j] >= tau for i, j in got.items() if j >= 0)
    wide = np.concatenate([m, np.full((14, 14), tau)], 1)
    best = wide[np.arange(14), assignment.solve(-wide)].sum()
    assert sum(m[i, j] if j >= 0 else tau for i, j in got.items()) == pytest.approx(best)
    with pytest.raises(ValueError, match="more than one task"):
        assignment.assign(scores(spark, m.tolist()), tau, most_pairs=3)


def test_positions_in_ranges(spark, monkeypatch):
    rng = random.Random(3)
    order = rng.sample(range(10_000), 900)
    df = spark.createDataFrame([(k, f"f{k}") for k in order], "first_line long, field_id string")
    monkeypatch.setattr(catalog, "NUMBERED_AT_ONCE", 100)
    got = {r.field_id: r.pos for r in catalog.positions(df).collect()}
    assert got == {f"f{k}": i for i, k in enumerate(sorted(order))}


def test_header_cells():
    assert catalog.header_cells("\ufeffName,\"a, b\", Type ") == ["name", "a, b", "type"]


def test_encoders_by_name(spark, fields, monkeypatch):
    src, tgt, _ = fields
    with pytest.raises(NotImplementedError, match="register_encoder"):
        matchers.score("E5", src, tgt)
    with pytest.raises(ValueError, match="unknown encoder"):
        matchers.register_encoder("other", len)
    monkeypatch.setattr(matchers, "MATCHERS", dict(matchers.MATCHERS))
    rows = [(r.pos, r.text) for c, role in ((src, "query"), (tgt, "passage")) for r in matchers.encoder_text(c, "e5", role).orderBy("pos").collect()]
    assert rows[0] == (0, "query: name source ip type string path event src ip") and rows[3][1].startswith("passage: name source address type string")
    assert matchers.encoder_text(src, "mdv", "query").orderBy("pos").first().text.startswith("[NAME] Source IP [TYPE]")

    def encode(texts):
        import numpy as np

        return np.array([[len(t), t.count("e") + 1.0] for t in texts])

    matchers.register_encoder("e5", encode)
    got = {(r.src_pos, r.tgt_pos): r.score for r in matchers.score("e5", src, tgt).collect()}
    v = encode([t for _, t in rows])
    for (i, j), s in got.items():
        assert s == pytest.approx(v[i] @ v[3 + j] / np.linalg.norm(v[i]) / np.linalg.norm(v[3 + j]))
    assert len(got) == 9


def test_component_cosines_and_library_score(spark, fields):
    src, tgt, _ = fields
    src = src.withColumn("type", F.when(F.col("pos") == 1, "").otherwise(F.col("type")))
    embed = lambda df, role: df.withColumn("embedding", matchers.md5_embedding(F.col("text")))
    parts = {(r.src_pos, r.tgt_pos): r for r in matchers.component_cosines(src, tgt, embed).collect()}
    vectors = {r.t: np.array(r.e) for r in spark.createDataFrame([(x,) for row in A + B for x in row[1:]], "t string").distinct().select("t", matchers.md5_embedding(F.col("t")).alias("e")).collect()}
    for (i, j), r in parts.items():
        for k, name in ((1, "name_score"), (2, "type_score"), (3, "path_score")):
            want = 0.0 if i == 1 and k == 2 else float(vectors[A[i][k]] @ vectors[B[j][k]])
            assert getattr(r, name) == pytest.approx(want, abs=1e-9)
    texts = lambda rows: [X_plain(" ".join((n, "" if i == 1 and rows is A else t, p))) for i, (_, n, t, p) in enumerate(rows)]

    def X_plain(t):
        return spark.range(1).select(X.plain_tokens(F.lit(t)).alias("t")).first().t

    lex = brute_bm25(texts(A), texts(B))
    top = max(map(max, lex))
    for r in matchers.integrated_library(src, tgt, embed).collect():
        p = parts[r.src_pos, r.tgt_pos]
        assert r.score == pytest.approx(p.name_score + 0.3 * p.type_score + p.path_score + 0.1 * lex[r.src_pos][r.tgt_pos] / top)


def test_run_modes(spark, tmp_path, fields):
    files = [write(tmp_path / f"{n}.jsonl", [dict(zip(("field_id", "name", "type", "path"), r)) for r in rows]) for n, rows in (("a", A), ("b", B))]
    every = write(tmp_path / "p.jsonl", [{"source": s, "target": t} for s, t in PAIRS])
    calib = write(tmp_path / "q.jsonl", [{"source": s, "target": t} for s, t in PAIRS[:2]] + [{"source": "action", "target": "security_action", "label": 0}])
    out = evaluation.run(spark, *files, every, "single", "overlap", pairs_calib=calib, calibrate=True, n_boot=30)
    assert out["n_eval"] == 3 and "ece_after" in out and 0 <= out["hit@1_ci"][0] <= out["hit@1_ci"][1] <= 1
    assert evaluation.run(spark, *files, every, "latency3", "overlap").keys() == {"embed_sec", "score_rank_sec", "calibration_sec", "total_sec", "ms_per_source"}
    table = evaluation.run(spark, *files, every, "table3", weights=(1.0, 0.0, 0.0))
    assert {k: v for k, v in table["weighted"].items() if k != "setting"} == {k: v for k, v in table["name"].items() if k != "setting"}
    assert evaluation.run(spark, *files, every, "table4", "overlap", pairs_calib=calib)["ece_before"] >= 0


@pytest.mark.parametrize("tile, terms", [(2000, 4096), (2, 7)])
def test_tfidf_top_k_by_tiles(spark, fields, tile, terms):
    s, t = (matchers.sparse_catalog(c) for c in fields[:2])
    corpus = matchers.tfidf_corpus(s, t)
    every = lexical.tfidf_cosine(corpus, X.tokens("text"), F.col("text")).select(F.col("a").alias("src_pos"), F.col("b").alias("tgt_pos"), F.round("score", 6).alias("score"))
    want = sorted((r.src_pos, r["rank"], r.tgt_pos, r.score) for r in ranking.top_k(every, 2).collect())
    got = lexical.tfidf_top_k(corpus, X.tokens("text"), F.col("text"), 2, tile=tile, terms=terms)
    assert [(a, k, b) for a, k, b, _ in want] == [(a, k, b) for a, k, b, _ in sorted((r.src_pos, r["rank"], r.tgt_pos, r.score) for r in got.collect())]
    assert [x[3] for x in want] == pytest.approx([x for *_, x in sorted((r.src_pos, r["rank"], r.tgt_pos, r.score) for r in got.collect())], abs=2e-6)


def test_matcher_from_outside(spark, fields, monkeypatch):
    """A matcher that another module registers is called by name, in the sweep too, and may fail without stopping it."""
    src, tgt, table = fields
    monkeypatch.setattr(matchers, "MATCHERS", dict(matchers.MATCHERS))
    matchers.register_matcher("Equal_Place", lambda a, b: pairs.all_pairs(a, b).select("src_pos", "tgt_pos", (F.col("src_pos") == F.col("tgt_pos")).cast("double").alias("score")))
    out = evaluation.sweep(src, tgt, table, ["equal_place", "mdv"])
    assert out["equal_place"]["hit_at_1"] == 1.0 and "no model" in out["mdv"]["error"]
    with pytest.raises(ValueError, match="unknown matcher"):
        matchers.score("none", src, tgt)


def test_calibrated_matches(spark, fields):
    src, tgt, table = fields
    rows = evaluation.calibrated_matches(src, tgt, table.where("source <> 'action'")).orderBy("src_pos").collect()
    assert [r.src_pos for r in rows] == [0, 1, 2] and all(0 <= r.fitted <= 1 for r in rows)
    s = matchers.overlap_matcher(src, tgt)
    best = {r.src_pos: (r.tgt_pos, r.score) for r in ranking.top_k(s, 1).collect()}
    assert {r.src_pos: (r.tgt_pos, r.conf) for r in rows} == best
    known = {i: float(j == best[i][0]) for i, j in ((0, 0), (1, 1))}
    order = sorted(known, key=lambda i: best[i][1])
    fit = [known[i] for i in order] if known[order[0]] <= known[order[1]] else [sum(known.values()) / 2] * 2
    if best[0][1] != best[1][1]:
        assert [r.fitted for i in order for r in rows if r.src_pos == i] == fit
