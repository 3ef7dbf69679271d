"""Every registered query against its SQL on the small tables, and the contract of the entry module."""

import math
from pathlib import Path

import pytest

import __spark_entry__
from fieldloom.plans import registry

duckdb = pytest.importorskip("duckdb")
SLOW = {"bm25_ensemble", "tfidf_ensemble"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def as_rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted((tuple(map(plain, r)) for r in pdf[names].values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - SLOW))
def test_query(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        assert as_rows(got) == as_rows(db.sql(registry.ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    row = __spark_entry__.entry(spark).collect()
    assert len(row) == 1 and row[0].n_eval == 200
    assert registry.ORACLES.keys() <= registry.QUERIES.keys() <= __spark_entry__.queries().keys()
