import pytest

from newsloom.llm import mixing


def reshared(sizes):
    """Shares by weight, the excess over 3 times a source's size reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = {s: x for s, x in w.items() if s not in full}
        share = {s: (total - sum(full.values())) * x / sum(rest.values()) for s, x in rest.items()}
        above = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not above:
            return full | share
        full |= above


def check(docs, near=None):
    rows = mixing.mixed(docs).collect()
    texts = sorted((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect())
    assert sorted((r.doc_id, r.size) for r in rows) == texts
    sizes, taken, most, count = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = reshared(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (most[s] if near is None else near * want[s])
    again = mixing.mixed(docs).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix(small, edge, none):
    check(small, 0.01)
    check(edge)
    assert mixing.mixed(none).collect() == []


def test_small_blocks_and_repeated_rows(small, edge, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    monkeypatch.setattr(mixing, "FAN", 3)
    check(small.unionByName(small.select(*small.columns)))


def test_many_sources_are_shuffled(small, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    check(small)


def test_flight_balances():
    import random

    import numpy as np

    rng = random.Random(2)
    size = [rng.randint(1, 900) for _ in range(4000)]
    p = mixing.flight([0.37] * 4000, size, np.random.default_rng(1).random(4096), True)
    assert set(p) <= {0.0, 1.0}
    assert abs(sum(p) - 0.37 * 4000) <= 2
    assert abs(sum(a * b for a, b in zip(p, size, strict=True)) - 0.37 * sum(size)) <= max(size)


def test_many_flights_end_near_their_totals():
    import numpy as np

    rng, gaps = np.random.default_rng(4), []
    for _ in range(200):
        size = np.sort(np.ceil(rng.lognormal(5, 1.2, 50))).tolist()
        p = mixing.flight([0.3] * 50, size, rng.random(52), True)
        assert set(p) <= {0.0, 1.0}
        gaps.append(abs(sum(a * b for a, b in zip(p, size, strict=True)) / (0.3 * sum(size)) - 1))
        assert gaps[-1] <= max(size) / 2 / (0.3 * sum(size)) + (mixing.LAND + 2) / 15 / 100  # half the largest, and what documents weigh
    assert np.mean(gaps) < 0.005 and max(gaps) < 0.1  # the worst have a third of all words in two documents


def test_blocks_of_rows_without_id_and_of_one_id_are_even(spark):
    from pyspark.sql import functions as F

    rows = [(None if i % 2 else 7, f"{i} words of a text", "s") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = [r["count"] for r in docs.groupBy(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(16))).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 6000 / 16
    out = mixing.mixed(docs).collect()
    assert len(out) == 6000 and sum(r.taken for r in out) == sum(r.size for r in out)


def test_flights_keep_the_probabilities():
    import numpy as np

    rng = np.random.default_rng(6)
    size = [10, 25, 3, 90, 41, 7]
    mean = np.mean([mixing.flight([0.2, 0.7, 0.5, 0.4, 0.9, 0.3], size, rng.random(8), False) for _ in range(4000)], 0)
    assert np.abs(mean - [0.2, 0.7, 0.5, 0.4, 0.9, 0.3]).max() < 0.03
