import math
import random

from newsloom.llm import subspaces


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (v, label)
    near = {i: set() for i, _, _ in rows}
    for a, (v, la) in ok.items():
        for b, (w, lb) in ok.items():
            if a != b and la == lb and len(v) == len(w) and sum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(sum(x * x for x in v)) / math.sqrt(sum(x * x for x in w)) >= 0.98:
                near[a].add(b)
    label = {}
    for i in sorted(near):
        todo = [] if i in label else [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x]
    return {i: (len(near[i]), label[i]) for i in near}


def rows(rng, dim=24, n=260):
    out = []
    for i in range(n):
        base = [rng.gauss(0, 1) for _ in range(dim)]
        if out and rng.random() < 0.6:
            v = rng.choice(out)[1]
            scale = rng.choice([0, 0.05, 0.1, 0.2, 0.25])
            base = [rng.choice([1, 2]) * x + scale * rng.gauss(0, 1) for x in v] if scale else [3 * x for x in v]
        out.append((i, [float(x) for x in base], rng.randint(0, 2)))
    return out


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    all_ = rows(rng) + [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [1.0] * 24, None), (1004, [float("inf")] + [0.0] * 23, 1), (1005, [None, 1.0], 1), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (1009, [1e-200] * 24, 2), (1010, [1e200] * 24, 2)]
    df = spark.createDataFrame([(*r, "x") for r in all_], "vec_id long, embedding array<double>, label int, kept string")
    want = brute(all_[:-2]) | {1009: (1, 1009), 1010: (1, 1009)}
    for cell, wide in ((2000, 3000), (8, 5)):
        monkeypatch.setattr(subspaces, "CELL", cell)
        monkeypatch.setattr(subspaces, "WIDE", wide)
        got = {r.vec_id: (r.n_links, r.component_id) for r in subspaces.linked(df).collect()}
        assert got == want
    assert subspaces.linked(df.where("vec_id < 0")).collect() == []


def test_labels_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1.2), (2, [1.0, 0.01], 1.7), (3, [1.0, 0.02], 1.2), (1, [0.0, 1.0], 1.2), (4, [0.01, 1.0], 1.2), (4, [0.01, 1.0], 1.2)], "vec_id long, embedding array<double>, label double")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in subspaces.linked(df).collect()) == [(1, 1, 1), (1, 2, 1), (2, 0, 2), (3, 1, 1), (4, 2, 1), (4, 2, 1)]


def test_pairs_at_the_limit_are_decided_exactly(spark):
    rng, rows = random.Random(9), []
    for i in range(60):
        v = [rng.gauss(0, 1) for _ in range(16)]
        n = math.sqrt(sum(x * x for x in v))
        v = [x / n for x in v]
        u = [rng.gauss(0, 1) for _ in range(16)]
        d = sum(a * b for a, b in zip(u, v, strict=True))
        u = [b - d * a for a, b in zip(v, u, strict=True)]
        n = math.sqrt(sum(x * x for x in u))
        c = 0.98 + rng.choice([-1e-6, -1e-8, 1e-8, 1e-6])
        rows += [(2 * i, v, i % 4), (2 * i + 1, [c * a + math.sqrt(1 - c * c) * b / n for a, b in zip(v, u, strict=True)], i % 4)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in subspaces.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(rows)


def test_a_large_label_is_sent_once_for_each_block(spark, monkeypatch):
    """Rows sent grow with the table, not with the number of cells."""
    n, sent = 9000, []
    df = spark.range(n).selectExpr("id AS vec_id", "transform(sequence(1, 16), i -> randn(7) + sin(id * i)) AS embedding", "'x' AS label")
    whole = subspaces.verified
    monkeypatch.setattr(subspaces, "verified", lambda rows, cosine: [sent.append(rows.count()), whole(rows, cosine)][1])
    subspaces.linked(df).count()
    assert sent == [8 * n]
