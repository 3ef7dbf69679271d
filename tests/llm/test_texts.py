"""Line dedup, quality rules, BPE and SimHash against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import bpe, components, line_dedup, quality_rules, simhash
from fieldloom.llm.queries import QUERIES

from .cases import ROWS, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def brute_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    least = lambda i: -1 if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or least(i) == max(map(least, held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for docs, rows in ((df, texts(spark, sf)), (odd(spark, ["lines", "drops", "h", "keeper", "id"]), [r[:2] for r in ROWS])):
        got = line_dedup.dedup_lines(docs).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_text").collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs, rows in ((spark.read.parquet(f"{sf}/documents.parquet"), texts(spark, sf)), (odd(spark, ["kept", "n_words"]), [r[:2] for r in ROWS])):
        got = quality_rules.apply_rules(docs, labels).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter((i, *brute_counts(t)) for i, t in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
        kept = quality_rules.keep_by_rules(docs, labels)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_rules.apply_rules(empty(spark), labels).count() == 0
    assert quality_rules.apply_rules(odd(spark), labels.limit(0)).where("not kept and not base_failed").count() == 0


def test_clopper_pearson():
    for k, n, level in ((0, 20, 0.05), (3, 40, 0.01), (17, 1000, 0.001)):
        p = quality_rules.upper_bound(k, n, level)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(level, rel=1e-6)
    assert quality_rules.upper_bound(0, 0, 0.05) == 1 and quality_rules.upper_bound(5, 5, 0.05) == 1


def test_cutoffs_keep_the_risk():
    cells = {0: 5000, 10: 40, 64: 10}
    cut = quality_rules.choose_cutoffs({(1, "symbols"): cells}, risk=0.05, level=0.05)[1, "symbols"]
    over = sum(n for c, n in cells.items() if c > cut * quality_rules.GRID)
    assert quality_rules.upper_bound(over, 5050, 0.05 / (len(quality_rules.STRATA) * len(quality_rules.RULES))) <= 0.01
    assert quality_rules.choose_cutoffs({(1, "symbols"): {0: 20}}, 0.05, 0.05) == {}


def brute_verdicts(rows, quality, risk, level):
    """kept for each (id, text), by its own counts, cutoffs and binomial sums: no function of the operator is used."""
    from fractions import Fraction

    def ratios(text):
        n, chars, symbols, dup, repeat = brute_counts(text)
        upper = sum("A" <= c <= "Z" for c in text or "")
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        part = lambda a, b: min(Fraction(a, b), Fraction(1)) if b else Fraction(0)
        return {"symbols": part(symbols, chars), "capitals": part(upper, chars), "repeated_words": part(repeat, n), "repeated_lines": part(dup, lines), "symbols_per_word": part(symbols, n)}

    def at_most(k, n, limit, chance):
        """Is the rate bounded by limit: would k or fewer of n have at most that chance at the limit?"""
        return sum(math.comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(k + 1)) <= chance

    stratum = lambda n: sum(n >= low for low in (50, 200, 800))
    seen = {}
    for i, t in rows:
        n, _, _, _, repeat = brute_counts(t)
        seen[i] = (stratum(n), n < 50 or 100 * repeat > 50 * n, ratios(t))
    kept = {i: not failed for i, (_, failed, _) in seen.items()}
    for s in range(4):
        good = [r for i, (own, failed, r) in seen.items() if own == s and not failed and quality.get(i) == 1]
        for rule in ("symbols", "capitals", "repeated_words", "repeated_lines", "symbols_per_word"):
            best = None
            for cut in range(63, -1, -1):
                over = sum(r[rule] > Fraction(cut, 64) for r in good)
                if not good or not at_most(over, len(good), risk / 5, level / (4 * 5)):
                    break
                best = Fraction(cut, 64)
            for i, (own, _, r) in seen.items():
                if best is not None and own == s and r[rule] > best:
                    kept[i] = False
    return kept


@pytest.mark.parametrize("risk", [0.05, 0.6])
def test_quality_verdicts_by_brute_force(spark, risk):
    big = "/root/testdata/sf0.01"
    rows, labels = texts(spark, big), spark.read.parquet(f"{big}/labels.parquet")
    want = brute_verdicts(rows, {r.doc_id: r.quality for r in labels.collect()}, risk, 0.05)
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.read.parquet(f"{big}/documents.parquet"), labels, risk=risk).collect()}
    assert got == want
    base = sum(not (n < 50 or 100 * r > 50 * n) for n, _, _, _, r in (brute_counts(t) for _, t in rows))
    assert (sum(want.values()) < base) == (risk > 0.05)  # few labels allow no cutoff at the small risk


def test_quality_risk_on_labels_not_learned_from(spark):
    """Cutoffs from half of the labels reject no more good documents of the other half than the risk, in any stratum."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    half = lambda k: labels.where(f"crc32(cast(doc_id as string)) % 2 = {k}")
    out = quality_rules.apply_rules(spark.read.parquet(f"{big}/documents.parquet"), half(0), risk=0.05).where("not base_failed").join(half(1), "doc_id")
    cells = Counter((sum(r.n_words >= low for low in (50, 200, 800)), r.quality, r.kept) for r in out.select("n_words", "quality", "kept").collect())
    print("op5 other half:", sorted(cells.items()))
    for s in range(4):
        lost, n = cells[s, 1, False], cells[s, 1, False] + cells[s, 1, True]
        assert lost <= 0.05 * n + 3 * math.sqrt(0.05 * n)
    assert sum(cells[s, 0, False] for s in range(4)) > 0


def test_bpe(spark, sf):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.replay(path).ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd(spark, ["ids"]).select("doc_id", "text"))
    for r in bpe.encode_documents(docs.join(docs.distinct(), ["doc_id", "text"], "left"), path, pattern).join(docs.distinct(), "doc_id").collect():
        if r.doc_id > 12:
            assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    for text in ["aaaaaaaaaaaaa", "abababababab", "  \n\n  x", "the <|endoftext|>", "🙂🙂é", "ñ" * 99, ""]:
        assert bpe.encode_texts([text], path, pattern) == [lib.encode_ordinary(text)]
    rows = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS}
    assert {(r.doc_id, r.decoded_sha256) for r in bpe.encode_digests(odd(spark, ["n_tokens"]), path, pattern).collect()} == rows
    assert bpe.encode_documents(empty(spark), path, pattern).count() == 0


def test_latin_split_is_the_full_split():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import random

    import regex

    from fieldloom.llm import pretoken

    full, quick = regex.compile(public_tokenizers.PATTERN).findall, pretoken.splitter(public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("ab'st re \n\t\x1c\x85\xa0éßÀªµ²½019_-.#") if rng.random() < 0.8 else chr(rng.randrange(0x250)) for _ in range(rng.randrange(40)))
        assert quick(text) == full(text)
    assert quick("日本語 ２３ x") == full("日本語 ２３ x")


def brute_simhash(text, k=3):
    import xxhash

    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id reachable, for {id: fingerprint}."""
    up = {i: i for i in prints}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, sf):
    rows = texts(spark, sf)
    prints = {i: brute_simhash(t) for i, t in rows}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    got = simhash.near_duplicates(odd(spark, ["fp", "node"])).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (3, 4, 5, 6, 7, 8, 11)} == {3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 5, 11: 7}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_through_rows_without_an_id(spark, monkeypatch):
    """Fingerprints 0, 0b11 and 0b1111: the outer two are reachable through the middle one, whose rows have no id."""
    prints = {"a": 0, "b": 0b11, "c": 0b1111, "d": 1 << 40 | 1 << 50 | 1 << 60}
    rows = [(1, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "c"), (None, "d"), (2, "d"), (9, "d")]
    made = spark.createDataFrame([(i, prints[t]) for i, t in rows], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {0: 1, 0b11: 1, 0b1111: 1, prints["d"]: 2}
    assert sorted((r.doc_id or 0, r.fp, r.component_id) for r in got) == sorted((i or 0, prints[t], want[prints[t]]) for i, t in rows)
    made = made.where("fp = 3")
    assert {r.component_id for r in simhash.near_duplicates(made.selectExpr("id as doc_id", "'' as text")).collect()} == {None}


@pytest.mark.parametrize("pairwise", [0, 3, 24])
def test_simhash_links(spark, pairwise, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(pairwise)
    prints = {}
    for i in range(240):
        p = rng.getrandbits(64) if i < 40 else prints[rng.randrange(40)]
        for _ in range(rng.choice((0, 1, 2, 3))):
            p ^= 1 << rng.randrange(64)
        prints[i] = p
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    nodes = spark.createDataFrame([(i, simhash.signed(p)) for p, i in first.items()], "node long, fp long")
    got = {r.node: r.component for r in components.components(simhash.links(nodes)).collect()}
    want = brute_components({i: p for p, i in first.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (500, 600), (600, 700), (None, 3), (900, 900)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 400 for i in (400, 500, 600, 700)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
