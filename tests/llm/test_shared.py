"""The corpus queries that write tables also run where nobody has set spark.checkpoint.dir."""

from ..test_shared import rows_without_a_folder


def test_queries_without_a_folder(tmp_path, sf, spark):
    names = ["op1_line_dedup", "op2_sharding", "op3_html_extraction", "op5_quality_rules", "op7_packing", "op8_embedding_dedup", "op10_simhash", "pipeline"]
    got = rows_without_a_folder(tmp_path, sf, names)
    count = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    assert got.keys() == set(names)
    assert {got[n] for n in names if n[2] in "125" and n != "op10_simhash"} | {got["op10_simhash"]} == {count("documents")}
    assert got["op3_html_extraction"] == count("pages") and got["op8_embedding_dedup"] == count("embeddings")


def test_join_hot_is_a_join(spark, monkeypatch):
    """With keys of every size, some broadcast and some not, the result is that of a plain join."""
    from pyspark.sql import functions as F

    from fieldloom.llm import common

    monkeypatch.setattr(common, "MOST_HOT", 10)
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, if(id % 2 = 0, 1 + id % 50, id)) as k")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1")
    assert 0 < counted.where("n * 10 > 1000").count() < counted.count()
    for how in ("inner", "left"):
        want = rows.join(counted.drop("n"), "k", how).select("k", "id", "top")
        got = common.join_hot(rows, counted, ["k"], 1000, how).select("k", "id", "top")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert common.join_hot(rows.limit(0), counted.limit(0), ["k"], 0).count() == 0


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    """No row is lost or moved whatever the texts' lengths, nulls among them; a long text is alone."""
    import pyarrow as pa

    from fieldloom.llm import common

    monkeypatch.setattr(common, "ROWS_AT_ONCE", 5)
    monkeypatch.setattr(common, "BYTES_AT_ONCE", 100)
    texts = ["a" * n if n is not None else None for n in (10, 30, 500, None, 0, 99, 1, 1, 1, 1, 1, 1, 1, 200, 60, 60)]
    batch = pa.record_batch({"k": list(range(len(texts))), "t": pa.array(texts, pa.string()), "b": pa.array([None] * len(texts), pa.binary())})
    parts = list(common.slices(batch))
    assert [x for p in parts for x in p["k"].to_pylist()] == list(range(len(texts)))
    for p in parts:
        assert p.num_rows <= 5 and (p.num_rows == 1 or sum(len(x or "") for x in p["t"].to_pylist()) <= 100)
    assert list(common.slices(batch.slice(0, 0))) == []
    got = common.map_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string"), "k long, n long", lambda rows: ((k, len(t or "")) for k, t in rows))
    assert sorted(map(tuple, got.collect())) == [(i, len(t or "")) for i, t in enumerate(texts)]
