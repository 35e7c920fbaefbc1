"""The TF-IDF join over texts: the same rows as by weights, in few bytes a term."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import lexical, tiles


def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_pos long, topic string, hour int, text string")
    return df.withColumn("published_at", F.expr("timestampadd(HOUR, hour, TIMESTAMP '2024-01-01 00:00:00')")).withColumn("news_id", F.col("row_pos").cast("string"))


def made(n):
    rng = random.Random(5)
    words = [f"W{i}" for i in range(80)]
    rows = [(i * 7, rng.choice("aab"), rng.randint(0, 900), " ".join(rng.choices(words, [1 / (1 + k) for k in range(80)], k=rng.randint(0, 30)))) for i in range(n)]
    return rows + [(7 * n, "a", 5, None), (7 * n + 1, "a", 5, "--"), (7 * n + 2, None, 5, "w1 w2 w3"), (7 * n + 3, "b", 9, "einmalig nur hier")]


@pytest.mark.parametrize("dense,listed,at_once,block", [(512, 1 << 20, 1 << 21, 512), (0, 10, 60, 8), (7, 300, 500, 16), (1, 1 << 20, 1 << 21, 5)])
def test_texts_as_by_weights(spark, monkeypatch, dense, listed, at_once, block):
    rows = made(240)
    news = frame(spark, rows)
    w = {}
    for r in lexical.weights(news.select(F.col("row_pos").alias("id"), "text"), "id", "text", min_df=2, max_share=0.8).collect():
        w.setdefault(r.id, {})[r.term] = r.w
    want = {}
    for i, t, h, _ in rows:
        for j, u, g, _ in rows:
            if t == u and t and (h, i) < (g, j) and g - h <= 14 * 24 and i in w and j in w:
                s = sum(v * w[j].get(k, 0) for k, v in w[i].items())
                if s >= 0.15:
                    want[i, j] = s
    assert len(want) > 400, len(want)
    monkeypatch.setattr(lexical, "DENSE", dense)
    monkeypatch.setattr(lexical, "LISTED", listed)
    monkeypatch.setattr(tiles, "AT_ONCE", at_once)
    monkeypatch.setattr(tiles, "SPAN", 4)
    monkeypatch.setattr(tiles.Join.__init__, "__defaults__", (block, False))
    found = lexical.similar_texts(news, 0.15, 14, min_df=2, max_share=0.8).collect()
    got = {(r.a, r.b): r.similarity for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_rows_that_share_an_id_are_one(spark):
    rows = [(1, "a", 1, "x y"), (1, "a", 1, "y z"), (2, "a", 2, "x y z z"), (3, "a", 3, "q")]
    counted = {r.key: sorted(zip(r.terms, r.tfs, strict=True)) for r in lexical._counted(frame(spark, rows), "row_pos", "text").collect()}
    own = {r.w: r.m for r in spark.range(1).select(F.explode(F.array(*map(F.lit, "xyzq"))).alias("w")).select("w", F.xxhash64("w").alias("m")).collect()}
    pair = lambda a, b: int(lexical._paired(np.array([own[a]]), np.array([own[b]]))[0])
    assert counted[1] == sorted([(own["x"], 1), (own["y"], 2), (own["z"], 1), (pair("x", "y"), 1), (pair("y", "z"), 1)])
    assert counted[2] == sorted([(own["x"], 1), (own["y"], 1), (own["z"], 2), (pair("x", "y"), 1), (pair("y", "z"), 1), (pair("z", "z"), 1)])
    assert counted[3] == [(own["q"], 1)] and pair("x", "y") != pair("y", "x")


def test_a_run_without_terms_doubles_no_pair(spark):
    """Rows whose texts have no word leave a tile with one run's rows alone; those rows meet in their own tile only."""
    news = frame(spark, [(1, "a", 5, "red green blue"), (2, "a", 6, "red green blue"), (3, "a", 7, "red green sea"), (4, "a", 14 * 24 + 5, ""), (5, "a", 14 * 24 + 6, "...")])
    w = lexical.weights(news.select(F.col("row_pos").alias("id"), "text"), "id", "text").cache()
    for found in (lexical.similar(news, w, 0.2), lexical.similar_texts(news, 0.2)):
        assert sorted((r.a, r.b) for r in found.collect()) == [(1, 2), (1, 3), (2, 3)]


def test_terms_are_sent_in_few_bytes(spark, monkeypatch):
    """What goes to the tiles with a row, and so as often as its bucket has runs, is a third of 16 bytes a term at most."""
    rng = random.Random(6)
    rows = [(i, "a", i % 900, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(200))) for i in range(150)]
    sent = []
    tiled = tiles.Join.tiled

    def seen(self, schema, tile, more=None, size=0):
        sent.append(more)
        return tiled(self, schema, tile, more, size)

    monkeypatch.setattr(tiles.Join, "tiled", seen)
    news = frame(spark, rows)
    lexical.similar_texts(news, 0.3, 14, min_df=2).collect()
    parts = sent[0].collect()
    terms = lexical.weights(news.select(F.col("row_pos").alias("id"), "text"), "id", "text", min_df=2).count()
    assert len(parts) == 150 and sum(len(zlib.compress(bytes(r.terms), 1)) for r in parts) < 16 * terms / 3
