"""The join in blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import tiles

DAY = 86_400_000_000


def made(rng, n, spread):
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=12)
        rows.append((i, ["a", "a", "a", "b", None][int(rng.integers(5))], int(rng.integers(0, 40 * 24)), v.tolist() if i % 50 else None))
    rows += [(n + 1, "a", 5, [0.0] * 12), (n + 2, "a", 5, [float("nan")] * 12), (n + 3, "a", 5, [1.0, 0.0])]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_pos long, topic string, hour int, embedding array<double>")
    return df.withColumn("published_at", F.expr("timestampadd(HOUR, hour, TIMESTAMP '2024-01-01 00:00:00')")).withColumn("news_id", F.col("row_pos").cast("string"))


def brute(rows, threshold, days, by=True):
    out = {}
    own = [(h, i, t, np.array(v)) for i, t, h, v in rows if v is not None and not np.isnan(v).any() and (t is not None or not by)]
    own.sort(key=lambda r: r[:2])
    for k, (h, i, t, v) in enumerate(own):
        for g, j, u, w in own[k + 1 :]:
            if (t == u or not by) and len(v) == len(w) and g - h <= days * 24:
                s = float(v @ w / max(np.linalg.norm(v), 1e-12) / max(np.linalg.norm(w), 1e-12))
                if s >= threshold:
                    out[i, j] = (round(s, 9), round((g - h) / 24, 9))
    return out


@pytest.mark.parametrize("spread,threshold,block", [(0.1, 0.82, 8), (0.5, 0.6, 16), (1.0, -2.0, 512), (0.3, 0.0, 7)])
def test_pairs(spark, spread, threshold, block):
    rows = made(np.random.default_rng(1), 300, spread)
    for by in (None, []):
        got = {(r.a, r.b): (round(r.similarity, 9), round(r.days_diff, 9)) for r in tiles.similar(frame(spark, rows), threshold, 7, by, block=block).collect()}
        want = brute(rows, threshold, 7, by is None)
        assert set(got) == set(want) and np.allclose([got[k] for k in got], [want[k] for k in got], atol=1e-8)


def test_blocks_are_ruled_out_and_pairs_carry_no_vector(spark):
    rows = made(np.random.default_rng(2), 1500, 0.05)
    news = frame(spark, rows)
    join = tiles.Join(tiles.prepared(news, ["topic"], "row_pos"), 14, ["topic"], 0.9, 8)
    r = join.report().first()
    assert r.block_pairs == r.ruled_out_by_time + r.ruled_out_by_angle + r.tiles and r.ruled_out_by_angle > 0.5 * r.block_pairs
    assert tiles.similar(news, 0.9, 7).columns == ["a", "b", "similarity", "days_diff"]


def test_runs_of_blocks_are_sent_together(spark, monkeypatch):
    rows = made(np.random.default_rng(5), 300, 0.5)
    want = brute(rows, 0.4, 7)
    for span, at_once in ((1, 1 << 21), (3, 40)):
        monkeypatch.setattr(tiles, "SPAN", span)
        monkeypatch.setattr(tiles, "AT_ONCE", at_once)
        assert {(r.a, r.b) for r in tiles.similar(frame(spark, rows), 0.4, 7, block=5).collect()} == set(want)


def test_two_tables(spark):
    rows = made(np.random.default_rng(3), 200, 0.4)
    news = frame(spark, rows)
    new, old = news.where("row_pos % 4 = 0"), news.where("row_pos % 4 <> 0")
    got = {tuple(sorted((int(r.new), int(r.old)))) for r in tiles.similar_to(new, old, 0.5, 7, block=8).collect()}
    assert got == {tuple(sorted(p)) for p in brute(rows, 0.5, 7) if (p[0] % 4 == 0) != (p[1] % 4 == 0)}
    assert all(int(r.new) % 4 == 0 for r in tiles.similar_to(new, old, 0.5, 7, block=8).collect())


def test_best_earlier(spark):
    rows = made(np.random.default_rng(4), 250, 0.4)
    pairs = brute(rows, -2.0, 7)
    hours = {i: h for i, _, h, _ in rows}
    for r in tiles.best_earlier(frame(spark, rows), 7, 3, block=16).collect():
        own = sorted((-s, hours[a], a) for (a, b), (s, _) in pairs.items() if b == r.row_pos)
        assert r.n == len(own) and [x.key for x in r.tops] == [a for _, _, a in own[:3]]
        assert r.last.key == max((h, a) for _, h, a in own)[1]


def test_empty(spark):
    none = frame(spark, []).where("row_pos < 0")
    assert tiles.similar(none, 0.5, 7).collect() == [] and tiles.best_earlier(none, 7).collect() == []
