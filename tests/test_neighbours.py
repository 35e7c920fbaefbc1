"""Graph index, blocks of queries, and TF-IDF prefixes against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph, ivf, lexical, search


def frame(spark, x):
    return spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "news_id string, embedding array<double>")


def test_graph_recall_and_share_of_vectors_scored(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24))[rng.integers(300, size=12_000)] + 0.6 * rng.normal(size=(12_000, 24))
    x = np.concatenate([x, x[:100]])  # equal vectors too
    corpus = frame(spark, x)
    graph.built(corpus, shard=50_000).write.parquet(str(tmp_path / "g"))
    asked = corpus.where("news_id % 100 = 0").selectExpr("news_id AS query_id", "embedding AS query")
    found = graph.nearest(asked, spark.read.parquet(str(tmp_path / "g")), 10).cache()
    assert found.agg(F.max("scored")).first()[0] < 0.1 * len(x)
    truth = search.nearest_of_many(asked, corpus, 10)
    r = ivf.recall(found, truth).first()
    assert r.queries == 121 and r.recall >= 0.9


def test_graph_of_many_shards_and_edges(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(700, 8))
    corpus = frame(spark, x).union(spark.createDataFrame([("9999999", None)], "news_id string, embedding array<double>"))
    asked = corpus.where("news_id % 70 = 0").selectExpr("news_id AS query_id", "embedding AS query")
    for shard in (90, 1000, 1):
        own = corpus.where("news_id < 6 OR news_id % 70 = 0") if shard == 1 else corpus
        graph.built(own, shard).write.parquet(str(tmp_path / str(shard)))
        found = graph.nearest(asked, spark.read.parquet(str(tmp_path / str(shard))), 5)
        truth = search.nearest_of_many(asked, own.where("embedding IS NOT NULL"), 5)
        assert ivf.recall(found, truth).first().recall > (0.9 if shard > 1 else 0.99)
    none = corpus.where("news_id < 0")
    graph.built(none).write.parquet(str(tmp_path / "none"))
    assert graph.nearest(asked, spark.read.parquet(str(tmp_path / "none")), 5).collect() == []
    assert graph.nearest(asked.where("false"), spark.read.parquet(str(tmp_path / "90")), 5).collect() == []


def test_queries_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 6)).round(1)
    corpus = frame(spark, np.concatenate([x, x]))
    asked = corpus.where("news_id % 9 = 0").selectExpr("news_id AS query_id", "embedding AS query")
    whole = sorted(map(tuple, search.nearest_of_many(asked, corpus, 7).drop("score").collect()))
    monkeypatch.setattr(search, "QUERIES", 13)
    assert sorted(map(tuple, search.nearest_of_many(asked, corpus, 7).drop("score").collect())) == whole and len(whole) == 7 * 89


@pytest.mark.parametrize("least", [0.15, 0.42, 0.9])
def test_tfidf_prefixes_find_every_pair(spark, least):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, rng.choice("ab"), rng.randint(0, 900), " ".join(rng.choices(words, [1 / (1 + k) for k in range(60)], k=rng.randint(0, 25)))) for i in range(220)]
    rows += [(i + 220, t, h + 3, x) for i, t, h, x in rows[:10]]
    news = spark.createDataFrame(rows, "row_pos long, topic string, hour int, text string").withColumn("published_at", F.expr("timestampadd(HOUR, hour, TIMESTAMP '2024-01-01 00:00:00')")).withColumn("news_id", F.col("row_pos").cast("string"))
    w = lexical.weights(news.select(F.col("row_pos").alias("id"), "text"), "id", "text", min_df=2).cache()
    own = {}
    for r in w.collect():
        own.setdefault(r.id, {})[r.term] = r.w
    want = {}
    for i, t, h, _ in rows:
        for j, u, g, _ in rows:
            if t == u and (h, i) < (g, j) and g - h <= 14 * 24 and i in own and j in own:
                s = sum(v * own[j].get(k, 0) for k, v in own[i].items())
                if s >= least:
                    want[i, j] = s
    got = {(r.a, r.b): r.similarity for r in lexical.similar(news, w, least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    met = lexical.candidates(news, w, least, 14).count()
    assert met >= len(want) and lexical.prefixes(w, least).count() < w.count()


def test_tfidf_pairs_are_not_sent(spark, monkeypatch):
    """The rows that meet grow with the table, not with its pairs; small tiles give the same products."""
    rows = [(i, "ab"[i % 9 == 0], i * 5 % 700, " ".join(f"w{i * j % 23}" for j in range(i % 31))) for i in range(300)]
    news = spark.createDataFrame(rows, "row_pos long, topic string, hour int, text string").withColumn("published_at", F.expr("timestampadd(HOUR, hour, TIMESTAMP '2024-01-01 00:00:00')")).withColumn("news_id", F.col("row_pos").cast("string"))
    w = lexical.weights(news.select(F.col("row_pos").alias("id"), "text"), "id", "text").cache()
    found = lexical.similar(news, w, 0.2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a" not in plan and "_bucket" not in plan
    plain = lambda: {(r.a, r.b): round(r.similarity, 9) for r in lexical.similar(news, w, 0.2).collect()}
    want = plain()
    assert len(want) > 900
    for name, value in {"SPAN": 4, "AT_ONCE": 50, "RUN": 3000}.items():
        monkeypatch.setattr(lexical.tiles, name, value)
    monkeypatch.setattr(lexical.tiles.Join.__init__, "__defaults__", (8, False))
    assert plain() == want


def test_quantiles_equal_percentile(spark):
    from newsloom.operators import quantiles

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[x / 7 for x in range(40)]])) for _ in range(900)] + [("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "high": 1.0}
    got = sorted(map(tuple, quantiles.exact(df, F.col("v"), wanted, {"g": F.col("g")}).collect()), key=repr)
    want = sorted(map(tuple, df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in wanted.items()]).collect()), key=repr)
    assert got == want
    assert tuple(quantiles.exact(df, F.col("v"), wanted).first()) == tuple(df.agg(*[F.percentile("v", F.lit(q)) for q in wanted.values()]).first())
    assert quantiles.exact(df.where("false"), F.col("v"), wanted).first().mid is None


def test_an_exact_check_finds_what_walks_miss(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(7).normal(size=(500, 12))
    corpus = frame(spark, np.concatenate([x, x[:40]]))  # equal scores too
    graph.built(corpus, 200).write.parquet(str(tmp_path / "g"))
    asked = corpus.where("news_id % 20 = 0").selectExpr("news_id AS query_id", "embedding AS query")
    index = spark.read.parquet(str(tmp_path / "g")).withColumn("links", F.unhex(F.repeat(F.lit("FFFFFFFF"), F.col("n") * 2 * graph.LINKS)))  # no links at all
    plain = lambda df: sorted((r.query_id, r["rank"], r.news_id, round(r.score, 9)) for r in df.collect())
    truth = plain(search.nearest_of_many(asked, corpus, 5))
    assert plain(graph.nearest(asked, index, 5)) != truth
    assert plain(graph.nearest(asked, index, 5, exact=True)) == truth


def test_quantiles_by_bins(spark):
    from newsloom.operators import quantiles

    rng = random.Random(8)
    rows = [(g, round(rng.uniform(-1, 1), 3)) for g, n in (("a", 400), ("b", 401), ("c", 1), ("d", 2)) for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.5, 0.25, 0.0, 1.0):
        for bins in (4, 1 << 16):
            got = {r.g: r.q for r in quantiles.by_bins(df, F.col("v"), share, ["g"], "q", bins).collect()}
            assert {g: round(q, 9) for g, q in got.items()} == {g: round(float(np.quantile([v for h, v in rows if h == g and v is not None], share)), 9) for g in "abcd"}
