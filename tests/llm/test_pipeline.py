"""The pipeline's stages take effect and keep what they must."""

import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import near_text

from .cases import empty, odd
from .test_layout import check_pieces
from .test_texts import brute_counts, brute_lines, brute_simhash

BIG = "/root/testdata/sf0.01"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def brute_near(texts):
    """The smallest id of each group that 2-bit fingerprints or 0.8 of five-word shingles connect; how many pairs only the second links."""
    ids = sorted(texts)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (texts[i] or "").translate({c: c + 32 for c in range(65, 91)})) for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    prints = {i: brute_simhash(texts[i]) for i in ids}
    up = {i: i for i in ids}
    wide = 0

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, b in enumerate(ids):
        for a in ids[:n]:
            close = (prints[a] ^ prints[b]).bit_count() <= 2
            x, y = sorted((len(sets[a]), len(sets[b])))
            alike = x > 0 and x >= 0.8 * y and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            wide += alike and not close
            if alike or close:
                low, high = sorted((find(a), find(b)))
                up[high] = low
    return {i for i in ids if find(i) == i}, wide


def test_stages(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    first = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    docs, steps = first, [rows_of(first)]
    for name, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, BIG), "test")
        assert docs.columns == first.columns, name
        steps.append(rows_of(docs))
    start, ruled, classed, lined, deduped = steps
    failed = {i for i, r in start.items() for n, _, _, _, rep in [brute_counts(r.text)] if n < 50 or 100 * rep > 50 * n}
    assert not failed & ruled.keys()
    good = {i for i, q in labels.items() if q == 1 and i in start and i not in failed}
    assert len(good - ruled.keys()) <= 0.05 * len(good)
    assert classed.keys() <= ruled.keys()
    known = [i for i in ruled if i in labels]
    assert sum((i in classed) == bool(labels[i]) for i in known) >= 0.95 * len(known)
    for i, n, dropped, text in brute_lines([(i, r.text) for i, r in classed.items()]):
        assert (lined[i].text, lined[i].n_chars) == (text, len(text))
    firsts, wide = brute_near({i: r.text for i, r in lined.items()})
    assert deduped.keys() == firsts and wide >= 5
    out = p.STAGES[-1][1](spark, docs, BIG).collect()
    tokens, padded = check_pieces(out, [(i, r.text) for i, r in deduped.items()], public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens >= 0.97 * padded


def test_odd_rows(spark, sf):
    import corpus_pipeline as p

    for docs in (odd(spark, ["kept", "row", "score"]), empty(spark)):
        for _, stage in p.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
            stage(spark, docs, sf).count()
    left = p.near_duplicates(spark, odd(spark), sf)
    assert left.where(F.col("doc_id").isin(4, 6, 8, 11)).count() == 0
    assert left.where("doc_id is null").count() == 0 or left.where("doc_id is null").count() == 1


def test_near_duplicates_share_five_word_shingles(spark, sf, monkeypatch):
    """The stage keeps one of each group that 2-bit fingerprints or a similarity of 0.8 connect, as brute force does."""
    import random

    import corpus_pipeline as p

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for k in range(40):
        base = [word() for _ in range(64 if k else 400)]
        for changes in (0, 1, 2) if k else (0, *[8] * 60):
            copy = list(base)
            for at in rng.sample(range(5, len(base) - 5), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    firsts, wide = brute_near(dict(enumerate(texts)))
    assert wide >= 20
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], odd(spark).schema)
    for pairs, tile in ((near_text.PAIRS, near_text.TILE), (0, 7), (60, 1000)):  # in rows, in many blocks, in both
        monkeypatch.setattr(near_text, "PAIRS", pairs)
        monkeypatch.setattr(near_text, "TILE", tile)
        assert {r.doc_id for r in p.near_duplicates(spark, docs, sf).collect()} == firsts


def test_near_duplicates_repeated_and_null_ids(spark, sf):
    """One row stays for each group, also where rows repeat an id or have none."""
    import corpus_pipeline as p

    rows = [(7, "alpha beta gamma", "en"), (7, "alpha beta gamma", "en"), (7, "alpha beta gamma", "de"), (3, "delta one two", "en"), (9, "delta one two", "en")]
    rows += [(9, "other words here", "en"), (None, "alpha beta gamma", "en"), (None, "no id at all", "en"), (None, "no id at all", "en"), (None, "delta one two", "de")]
    docs = spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t, lang in rows], odd(spark).schema)
    left = p.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, "no id at all"), (3, "delta one two"), (7, "alpha beta gamma"), (9, "other words here")]


def test_run_is_registered(spark):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_rows_are_told_by_place(spark, tmp_path):
    """Stored and made rows, clashing names and plans that repeat a place give the same rows."""
    names = ["_metadata", "file", "at", "row", "t", "c", "band"]
    made = odd(spark, names)
    made.write.parquet(str(tmp_path / "docs"))
    odd(spark).write.parquet(str(tmp_path / "plain"))
    stored, plain = spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "plain"))
    assert near_text.plain_scan(plain) and near_text.plain_scan(plain.where("lang is not null").select("text", "doc_id"))
    twice = plain.selectExpr("*", "explode(array(1, 2)) as copy").drop("copy")
    assert not near_text.plain_scan(twice) and not near_text.plain_scan(plain.union(plain)) and not near_text.plain_scan(made)
    want = sorted((r.doc_id or 0, r.text or "") for r in near_text.one_of_each(plain).collect())
    assert len(want) == len({t for _, t in want})
    for docs in (made, stored, twice, plain.union(plain), odd(spark)):
        out = near_text.one_of_each(docs)
        assert out.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == want
    assert near_text.one_of_each(plain.limit(0)).count() == 0
