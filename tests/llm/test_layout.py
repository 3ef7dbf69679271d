"""Sharding and packing: their laws hold on real and odd rows."""

import array
import random
import zlib
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import packing, sharding
from fieldloom.llm.queries import QUERIES

from .cases import ROWS, empty, odd


def check_shards(rows, texts, shards=24):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = [len(slots.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    first = {i: t for i, t in texts}
    for r in rows:
        data = (first[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def cut_edges(rows, texts):
    """Pairs of neighbours in a chain through each group that lie in different shards, and all such pairs."""
    text = dict(texts)
    groups = defaultdict(list)
    for r in rows:
        if text[r.doc_id] is not None:
            groups[text[r.doc_id]].append(r.shard)
    return sum(len(set(s)) - 1 for s in groups.values()), sum(len(s) - 1 for s in groups.values())


def test_sharding(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    check_shards(rows, texts)
    cut, total = cut_edges(rows, texts)
    assert cut == 0 < total
    check_shards(sharding.shard_documents(odd(spark, ["uid", "grp", "shard"])).collect(), [r[:2] for r in ROWS])
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_sharding_splits_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_ROWS", 20)
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    texts = [(i, "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 3 == 1 else f"text {i // 12}") for i in range(600)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=5).collect()
    check_shards(rows, texts, 5)
    cut, total = cut_edges(rows, texts)
    assert cut <= 0.15 * total


def test_sharding_gathers_a_hot_group(spark):
    """A third of all rows has one text, by the constants of production: 8 shards hold it, each unit less than full."""
    texts = [(i, "hot" if i % 3 == 0 else f"triple {i // 90}" if i % 30 == 1 else f"text {i}") for i in range(30_000)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_shards(rows, texts)
    assert len({r.shard for r in rows if texts[r.doc_id][1] == "hot"}) <= 10
    cut, total = cut_edges(rows, texts)
    assert cut <= 0.01 * total


def brute_first_fit(lengths, room):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, used in enumerate(bins):
            if used + lengths[i] <= room:
                break
        else:
            b = len(bins)
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tournament_is_first_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(rng.choice((1, 2, 7, 300)))]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    assert dict(enumerate(zip(bins, offsets))) == brute_first_fit(lengths, 100)


def check_pieces(rows, texts, path, room=2048):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(path)  # as the library reads it, untouched
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(ids) > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(array.array("I", ids).tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, _ in texts)
    for i, ids in want.items():
        assert sum(n for _, n in pieces[i]) == len(ids) * copies[i]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    used = [sum(n for _, n in p) for p in sequences.values()]
    return sum(used), sum(u if u & (u - 1) == 0 else room for u in used)


def test_packing(spark, sf):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    tokens, padded = check_pieces(QUERIES["op7_packing"](spark, sf).collect(), texts, path)
    assert tokens >= 0.97 * padded
    rows = packing.pack(odd(spark, ["ids", "group", "deal"]), path, public_tokenizers.PATTERN, group_pieces=4).collect()
    check_pieces(rows, [r[:2] for r in ROWS], path)
    assert all(zlib.crc32(array.array("I", r.ids).tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_added_tokens_are_the_librarys(spark, tmp_path):
    """A text that holds the string of an added token gets its id, by either encoder."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import json

    tokenizers = pytest.importorskip("tokenizers")
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "x<|endoftext|> y\n <|endoftext|>", " <|ENDOFTEXT|>", ""]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, pattern).collect()
    check_pieces(rows, list(enumerate(texts)), path)
    model = json.loads(open(path, encoding="utf-8").read())
    model["added_tokens"][0]["lstrip"] = True  # beyond what the quick encoder does
    other = tmp_path / "other.json"
    other.write_text(json.dumps(model), encoding="utf-8")
    for file in (path, str(other)):
        lib, encode = tokenizers.Tokenizer.from_file(file), packing.encoder(file, pattern)
        for t in texts:
            assert encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids
        lib.encode_special_tokens = True
        for t in texts:
            assert packing.encoder(file, pattern, added_as_text=True)(t).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert packing.encoder(path, pattern)(texts[0]).tolist() == [64, 220, 50256, 275]
