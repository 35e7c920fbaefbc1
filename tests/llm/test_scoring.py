import math
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import attention, scoring
from newsloom.llm.tokens import WordEncoder, vocabulary

BYTE = vocabulary("byte_bpe_50k.json")


def base(rows):
    words = {d: [w.lower() for w in (t or "").encode().split()] + [None] for d, t in rows}
    train = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    return {d: (zlib.crc32(str(d).encode()) % 7 == 2, len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in words.items()}


def check(docs):
    want = base([(r.doc_id, r.text) for r in docs.collect()])
    rows = scoring.scored(docs, BYTE).collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    return rows


def test_documents(spark, small, edge, none):
    """The score of documents that the model has not seen is above the base's, and other partitions give the same."""
    rows = check(small)
    for held_out in (True, False):
        own = [r for r in rows if r.held_out == held_out]
        assert own and sum(r.score for r in own) > sum(r.base_score for r in own)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = scoring.scored(small.repartition(5), BYTE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    first = {r.doc_id: r.score for r in rows}
    assert all(r.score == pytest.approx(first[r.doc_id], rel=1e-9) for r in again)
    check(edge)
    assert scoring.scored(none, BYTE).collect() == []


def test_word_probabilities_sum_to_at_most_one(spark, monkeypatch):
    """Over all words of two letters, after each of some beginnings."""
    import itertools

    monkeypatch.setattr(scoring, "held_out", lambda d: d >= 1000)
    letters = "abcdefgh"
    words = ["".join(w) for w in itertools.product(letters, repeat=2)]
    rng = np.random.default_rng(9)
    train = [(d, " ".join(rng.choice(words[:40], 30))) for d in range(40)]
    ask = [(1000 + i, f"{start} {w}") for start, i0 in (("ab", 0), ("zz", 100)) for i, w in enumerate(words, i0)]
    rows = scoring.scored(spark.createDataFrame(train + ask + [(2000, "ab"), (2001, "zz")], "doc_id long, text string"), BYTE).collect()
    own = {r.doc_id: 10**r.score for r in rows}
    for at, alone in ((0, 2000), (100, 2001)):
        assert 0 < sum(own[1000 + at + i] for i in range(len(words))) < 1 and own[alone] < 1


def test_only_held_out_documents(spark):
    ids = [i for i in range(200) if scoring.held_out(i)][:3]
    df = spark.createDataFrame([(i, "The cat <|endoftext|> sat") for i in ids], "doc_id long, text string")
    for r in scoring.scored(df, BYTE).collect():
        assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 5, 0.0)
        assert math.isfinite(r.score)


def small_model(ids=3000):
    rng = np.random.default_rng(0)
    begins = rng.random(ids) < 0.5
    begins[ids - 1] = True
    counts = rng.integers(0, 50, ids)
    classes = attention.Classes.by_counts(counts, begins, ids - 1)
    p = attention.start(np.bincount(classes.of, counts, classes.n))
    for k in ("gw", "cw"):
        attention.views(p)[k][:] *= 20
    return classes, p, ids


def test_classes_are_pure_and_sum_to_one():
    classes, _, ids = small_model()
    used = np.unique(classes.of)
    assert sum(np.exp(classes.within[classes.of == c]).sum() for c in used) == pytest.approx(len(used))
    assert classes.end < classes.begin and (classes.of == classes.end).sum() == 1
    few = attention.Classes.by_counts(np.array([5, 0, 3]), np.array([True, False, True]), 2)
    assert few.of[2] != few.of[0] and few.of[1] >= few.begin


def test_attention_is_causal_and_normalised():
    classes, p, _ = small_model()
    p = attention.views(p)
    rng = np.random.default_rng(1)
    x = rng.integers(0, classes.n, (3, attention.WINDOW))
    m = attention.forward(p, x)
    every = [attention.log_probabilities(p, m, np.full(len(m), c)) for c in range(classes.n)]
    assert np.allclose(sum(np.exp(a) for a, _ in every), 1, atol=1e-4)
    assert np.allclose(sum(np.exp(a) for a, _ in every[: classes.begin]), np.exp(every[0][1]), atol=1e-4)
    x2 = x.copy()
    x2[:, 20:] = 0
    m2 = attention.forward(p, x2)
    keep = np.tile(np.arange(attention.WINDOW) < 20, 3)
    assert np.allclose(m[keep], m2[keep], atol=1e-5)


def test_each_place_is_scored_once():
    assert attention.WINDOW - attention.STRIDE >= 8
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    doc, first, skip = attention.windows(lengths)
    for d, n in enumerate(lengths):
        got = [f + i for e, f, s in zip(doc, first, skip, strict=True) if e == d for i in range(attention.WINDOW) if i >= s and f + i < n]
        assert sorted(got) == list(range(n))
    classes, p, _ = small_model()
    y = np.random.default_rng(2).integers(0, classes.n, 300)
    a, b = attention.score(p, classes, y, np.array([100, 200]))
    a2, _ = attention.score(p, classes, y[100:], np.array([200]))
    assert (a < 0).all() and (b <= 1e-6).all() and np.allclose(a[100:], a2, atol=1e-4)
    other = y[:20].copy()
    other[10] = (other[10] + 1) % classes.n
    assert attention.score(p, classes, other, np.array([20]))[0][19] != attention.score(p, classes, y[:20], np.array([20]))[0][19]


def test_gradient():
    classes, p, _ = small_model()
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, classes.n, (2, 4, attention.WINDOW))
    w = rng.random((4, attention.WINDOW)) < 0.8
    g = attention.views(np.zeros(attention.WEIGHTS))
    attention.gradient(attention.views(p.astype(np.float64)), x, y, w, g)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        near = []
        for step in (1e-3, -1e-3):
            q = p.astype(np.float64)
            attention.views(q)[k][i] += step
            near.append(attention.gradient(attention.views(q), x, y, w, attention.views(np.zeros(attention.WEIGHTS))))
        assert g[k][i] == pytest.approx((near[0] - near[1]) / 2e-3, rel=5e-2, abs=1e-6), k


def test_places_without_weight_are_only_read():
    """What stands at places without weight is context; no class is predicted there, and the rest is as if all were."""
    classes, p, _ = small_model()
    p = attention.views(p.astype(np.float64))
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, classes.n, (2, 5, attention.WINDOW))
    w = rng.random((5, attention.WINDOW)) < 0.7
    w[:, : attention.WINDOW - attention.STRIDE] = False
    a, b = np.zeros((2, attention.WEIGHTS))
    loss = attention.gradient(p, x, y, w, attention.views(a))
    assert attention.gradient(p, x, np.where(w, y, 10**6), w, attention.views(b)) == loss and (a == b).all() and a.any()
    need = np.flatnonzero(w)
    m = attention.forward(p, x)
    assert np.allclose(attention.forward(p, x, need), m[need], rtol=1e-12, atol=1e-12)
    assert -attention.log_probabilities(p, m[need], y.ravel()[need])[0].mean() == pytest.approx(loss, rel=1e-9)


def test_training_learns():
    classes, p, _ = small_model()
    x = np.tile(np.arange(attention.WINDOW + 1) % 4, (1024, 1))
    w = np.ones((1024, attention.WINDOW))
    loss = lambda q: attention.gradient(attention.views(q), x[:64, :-1], x[:64, 1:], w[:64], attention.views(np.zeros(attention.WEIGHTS, np.float32)))
    assert loss(attention.train(p, x[:, :-1], x[:, 1:], w, 0.02)) < loss(p) / 4


def test_learns_from_every_span(spark, monkeypatch):
    """The counts that the class table and the bias come from hold every word of every training document."""
    seen, by_counts = [], attention.Classes.by_counts
    monkeypatch.setattr(attention.Classes, "by_counts", lambda counts, *a, **b: seen.append(counts.copy()) or by_counts(counts, *a, **b))
    rng = np.random.default_rng(4)
    rows = [(d, " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))) for d, n in enumerate([1, 27, 28, 29, 90, 400, 33, 64])]
    scoring.scored(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    encoder = WordEncoder.of(BYTE, special=False)
    first = Counter(int(encoder.ids([w])[0]) for d, t in rows if not scoring.held_out(d) for w in t.encode().split())
    assert first and all(seen[0][i] >= n for i, n in first.items())


def test_learns_every_id_once(spark, monkeypatch):
    """Later ids of words count as well, each once."""
    seen, by_counts = [], attention.Classes.by_counts
    monkeypatch.setattr(attention.Classes, "by_counts", lambda counts, *a, **b: seen.append(counts.copy()) or by_counts(counts, *a, **b))
    rng = np.random.default_rng(5)
    rows = [(d, " ".join("".join(rng.choice(list("abcdefghij"), 9)) for _ in range(n))) for d, n in enumerate([0, 1, 5, 60, 200])]
    scoring.scored(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    encoder = WordEncoder.of(BYTE, special=False)
    want = Counter(int(i) for d, t in rows if not scoring.held_out(d) for i in [*encoder.ids(t.encode().split()), encoder.end])
    assert {i: seen[0][i] for i in np.flatnonzero(seen[0])} == want


def plain_scores(classes, weights, first, train, encoder, texts):
    """log10 of each text, and of its spelling alone: forward pass, class softmax and mixture written out for one place at a time."""
    p = {k: v.astype(float) for k, v in attention.views(weights).items()}
    size, window, stride = attention.SIZE, attention.WINDOW, attention.STRIDE

    def softmax(z):
        e = [math.exp(x) for x in z]
        return [x / sum(e) for x in e]

    def hidden(seen):  # the state after the last of the inputs
        e = [p["emb"][c] + p["pos"][i] for i, c in enumerate(seen)]
        q, k, v = np.split(e[-1] @ p["qkv"], 3)[0], [np.split(x @ p["qkv"], 3)[1] for x in e], [np.split(x @ p["qkv"], 3)[2] for x in e]
        a = softmax([float(q @ x) / attention.DIM**0.5 for x in k])
        h = e[-1] + sum(w * x for w, x in zip(a, v, strict=True)) @ p["o"]
        return h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]

    out = []
    for text in texts:
        words = [*[w.lower() for w in (text or "").encode().split()], None]
        spelled = [[encoder.end] if w is None else [int(i) for i in encoder.ids([w])] for w in words]
        y = [int(classes.of[i]) for ids in spelled for i in ids]
        x = [classes.end, *y[:-1]]
        logs = []
        for t, c in enumerate(y):
            k = 0 if t < window else 1 + (t - window) // stride  # the window that scores this place
            h = hidden(x[k * stride : t + 1])
            groups = softmax(h @ p["gw"] + p["gb"])
            inside = softmax(h @ p["cw"][c // size] + p["cb"][c // size])
            logs.append((math.log(groups[c // size]) + math.log(inside[c % size]), math.log(sum(groups[: attention.GROUPS // 2]))))
        at, total, alone = 0, 0.0, 0.0
        for n, (w, ids) in enumerate(zip(words, spelled, strict=True)):
            start = logs[at][0] - logs[at][1]  # a word begins where one can
            rest = sum(logs[at + j][0] for j in range(1, len(ids))) + sum(float(classes.within[i]) for i in ids)
            end = logs[at + len(ids)][1] if n + 1 < len(words) else 0.0
            by_letters = start + rest + end
            count = train[w]
            by_count = start + math.log(count / max(first[classes.of[ids[0]]], 1)) if count else -math.inf
            total += math.log((math.exp(by_letters) + math.exp(by_count)) / 2)
            alone += by_letters
            at += len(ids)
        out.append((total / math.log(10), alone / math.log(10)))
    return out


def test_scores_against_a_plain_version(spark, monkeypatch):
    """Of short texts, one of several windows, unknown words, and nothing at all."""
    got, fit = [], scoring.fit
    monkeypatch.setattr(scoring, "fit", lambda *a: got.append(fit(*a)) or got[-1])
    rng = np.random.default_rng(11)
    words = ["the", "cat", "sat", "internationalisation", "mat", "naïve", "x1", "ha"]
    rows = [(d, " ".join(rng.choice(words, rng.integers(0, 60)))) for d in range(60)] + [(60, None), (61, "unseenword of The cat <|endoftext|>"), (62, "the " * 70)]
    out = {r.doc_id: r for r in scoring.scored(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()}
    train = Counter(w for d, t in rows if not scoring.held_out(d) for w in [*[x.lower() for x in (t or "").encode().split()], None])
    want = plain_scores(*got[0], train, WordEncoder.of(BYTE, special=False), [t for _, t in rows])
    for (d, _), (score, alone) in zip(rows, want, strict=True):
        assert out[d].score == pytest.approx(score, rel=1e-3, abs=1e-3) and out[d].spelled_score == pytest.approx(alone, rel=1e-3, abs=1e-3)
