import math
import re
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest

from newsloom.llm import wand

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def terms(text):
    return [t.translate(UPPER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items):
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(1 for x in own if x[2]), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c, size in own:
            score = 0
            for t in terms(text):
                if t in c:
                    m = 100 - 75 + 75 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:10], 1)]
    return sorted(out, key=repr)


def check(docs, items, **how):
    got = [tuple(r) for r in wand.ranked_documents(docs, items, **how).collect()]
    assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_whole_table(small, items, spark, monkeypatch):
    check(small, items)
    monkeypatch.setattr(wand, "SHARD", 37)
    check(small.withColumnRenamed("lang", "score").withColumnRenamed("source", "rank"), items.selectExpr("*", "1 AS rank"))
    assert len(list(wand.item_blocks(items, 2000))) > 2
    check(small.where("doc_id < 300"), items, item_bytes=2000)


def test_edges(edge, none, items, spark):
    queries = spark.createDataFrame([(1, "the cat THE door"), (2, None), (3, ""), (4, "zzz nowhere"), (5, "x x x"), (1, "house"), (None, "mat, é")], "item_id long, text string")
    check(edge, queries)
    assert wand.ranked_documents(none, queries).collect() == []
    assert wand.ranked_documents(edge, queries.where("item_id < 0")).collect() == []


def test_ties_and_missing_ids(spark):
    rows = [(None if i % 7 == 0 else i % 30, "same words here" if i % 2 else f"same word {i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, spark.createDataFrame([(0, "same words"), (1, "here same same"), (2, "word 3")], "item_id long, text string"))


def test_blocks_have_the_least_error():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, widest = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        scores = rng.integers(0, 50, (1, n)).astype(float)
        price = float(rng.integers(1, 60))

        def cost(begins, s=scores[0], price=price, widest=widest):
            at = [0, *[i for i, b in enumerate(begins, 1) if b], len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:], strict=False)]
            return math.inf if any(len(p) > widest for p in parts) else sum(price + (p.max() - p).sum() for p in parts)

        found = wand.cut(scores, np.array([n]), np.array([price]), widest)[0]
        assert found[0]
        assert cost(found[1:]) == pytest.approx(min(cost(b) for b in product([False, True], repeat=n - 1)))


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    size, counts = 4000, np.full(4000, 4)
    words = np.array([rng.choice(6, 4, replace=False) for _ in range(size)]).ravel().astype(np.int32)
    tf = np.where(np.repeat(np.arange(size) // 40 % 25 == 3, 4), 9, 1).astype(np.int32)
    shard = wand.Shard(np.full(size, 30), counts, words, tf, np.array([900, 500, 300, 700, 200, 100]), size, 30 * size)
    query = {0: 1, 2: 2, 3: 1}
    places, scores = shard.search(query, 1)
    own = np.zeros(size, np.int64)
    for t, q in query.items():
        at = shard.term == t
        own[shard.doc[at]] += q * shard.score[at]
    best = np.sort(own)[::-1][:10]
    assert np.array_equal(np.sort(scores)[::-1][:10], best) and np.array_equal(own[places], scores)
    assert set(np.flatnonzero(own >= best[-1])) <= set(places.tolist())  # ties at the end too
    assert shard.read < 0.2 * np.isin(shard.term, list(query)).sum()


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(con.execute(wand.ORACLE_SQL).fetchall()) == sorted(tuple(r) for r in wand.ranked_documents(docs, items).collect())
