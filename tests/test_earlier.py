"""The most similar earlier rows: found tile by tile, a row of partial results for each later row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import tiles


def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_pos long, topic string, hour int, embedding array<double>")
    return df.withColumn("published_at", F.expr("timestampadd(HOUR, hour, TIMESTAMP '2024-01-01 00:00:00')"))


def made():
    """Vectors of whole numbers, so many similarities are equal; many rows share an hour; some meet nothing."""
    rng = np.random.default_rng(11)
    rows = [(int(i), "aab"[int(rng.integers(3))], int(rng.integers(0, 200)) // 4, rng.integers(-1, 2, 4).astype(float).tolist()) for i in rng.permutation(260)]
    return rows + [(901, "a", 3, [float("nan")] * 4), (902, "a", 3, None), (903, None, 3, [1.0] * 4), (904, "c", 3, [1.0] * 4), (905, "a", 3, [1.0, 0.0])]


def brute(rows, days, k):
    own = sorted(((h, i, t, np.array(v) / max(np.linalg.norm(v), 1e-12)) for i, t, h, v in rows if v is not None and t is not None and not np.isnan(v).any()), key=lambda r: r[:2])
    out = {}
    for n, (h, i, t, v) in enumerate(own):
        met = [(round(float(v @ w), 12), g, j) for g, j, u, w in own[:n] if u == t and len(v) == len(w) and h - g <= days * 24]
        if met:
            best = sorted(met, key=lambda m: (-m[0], m[1], m[2]))[:k]
            out[i] = (len(met), [(round(s, 9), j) for s, _, j in best], max((g, j) for _, g, j in met)[1])
    return out


@pytest.mark.parametrize("days,k,block,span,at_once", [(36500, 5, 512, 32, 1 << 21), (36500, 5, 7, 4, 40), (1, 3, 16, 2, 300), (0.25, 1, 5, 1, 1)])
def test_equal_similarities_in_many_tiles(spark, monkeypatch, days, k, block, span, at_once):
    rows = made()
    monkeypatch.setattr(tiles, "SPAN", span)
    monkeypatch.setattr(tiles, "AT_ONCE", at_once)
    found = tiles.best_earlier(frame(spark, rows), days, k, block=block).collect()
    got = {r.row_pos: (r.n, [(round(x.s, 9), x.key) for x in r.tops], r.last.key) for r in found}
    assert len(found) == len(got) > 200 and got == brute(rows, days, k)


def test_a_tile_gives_a_row_for_each_later_row(spark, monkeypatch):
    """However few pairs are held at once, partial results grow with the runs that a row meets (here one in each of four partitions), not with the pairs."""
    made_of = []
    tiled = tiles.Join.tiled

    def seen(self, schema, tile, *more):
        made_of.append(tiled(self, schema, tile, *more))
        return made_of[-1]

    monkeypatch.setattr(tiles.Join, "tiled", seen)
    monkeypatch.setattr(tiles, "AT_ONCE", 50)
    rows = [(i, "a", i, [1.0, float(i)]) for i in range(200)]
    assert tiles.best_earlier(frame(spark, rows), 36500, 5).count() == 199 <= made_of[0].count() <= 4 * 199
