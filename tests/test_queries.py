"""Every registered query of the library against its DuckDB counterpart."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.plans import base, catalogue

SF = "/root/testdata/sf0.001"
#: Queries without SQL, and the test that holds their results against a plain version.
BY_HAND = {
    "t08_seeded_sample": "test_sequential.py::test_seeded_sample",
    "t10_budgeted_clusters": "test_sequential.py::test_budgeted_clusters",
    "g08_online_lifecycle": "test_sequential.py::test_online_lifecycle",
    "g09_nearest_topic": "test_sequential.py::test_nearest_topic",
    "st02_incremental_assignment": "test_streaming.py",
    "x12_feature_importances": "test_sequential.py::test_feature_importances",
    "x07_trained_adapter": "test_sequential.py::test_trained_adapter",
    "x06_trained_classifier": "test_sequential.py::test_trained_classifier",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert BY_HAND[name] and got, "a query has SQL or a test of its own"
        return
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_only_texts_with_a_vector_are_joined(spark, monkeypatch):
    """Before the join the documents are cut to those with a vector, so no other text is shuffled."""
    kept = base.news(spark, SF)
    assert "LeftSemi" in kept._jdf.queryExecution().optimizedPlan().toString()
    hashed = lambda df: sorted(r[0] for r in df.select(F.xxhash64(*df.columns)).collect())
    want = hashed(kept)
    monkeypatch.setattr(base, "FEW", -1)
    assert hashed(base.news(spark, SF)) == want and want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
