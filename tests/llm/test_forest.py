import random

import numpy as np
import pytest

from newsloom.llm import forest


def check(docs, **more):
    want = forest.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_links, r.component_id) for r in forest.linked(docs, **more).collect()}
    assert got == want
    return got


def test_documents(small, edge, none):
    got = check(small)
    assert sum(n > 0 for n, _ in got.values()) > 50
    check(edge)
    assert forest.linked(none).collect() == []


def near_copies(rng, n, words=120, edits=3):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 50)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def test_groups_split_into_blocks(spark, monkeypatch):
    rng = random.Random(8)
    texts = [t for n in (90, 40, 2, 2, 3, 1, 1) for t in near_copies(rng, n)] + ["a b", "a b", "a  b", "", None, "a b c d e", "b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    monkeypatch.setattr(forest, "BLOCK", 16)
    monkeypatch.setattr(forest, "WIDE", 20)
    check(df)


def test_depth_reaches_the_recall():
    for s in (0.8, 0.84, 0.9):
        x = forest.depth(s)
        assert 1 - (1 - s**x) ** forest.TREES >= forest.RECALL
        assert x == forest.DEPTH or 1 - (1 - s ** (x + 1)) ** forest.TREES < forest.RECALL


def test_least_similarity():
    for n in range(1, 60):
        own = [c / (n + m - c) for m in range(1, 100) for c in range(1, min(n, m) + 1) if c / (n + m - c) >= 0.8 and (m, c) != (n, n)]
        assert forest.least_similarity(np.array([n]))[0] == pytest.approx(min(own, default=2.0)), n


def test_prefixes_of_several_lengths_are_walked():
    """Rows join at the longest prefix that they share; a pair that needs a longer one than it shares is left."""
    label = np.array([[1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 2], [1, 1, 1, 1, 2, 3], [1, 1, 1, 1, 2, 4], [1, 1, 1, 1, 3, 5]])
    sketch, n = np.zeros((5, 64), np.uint8), np.full(5, 100)
    walk = lambda need, shortest, sketch=sketch: forest.climbed(label, n, np.array(need), sketch, shortest, 0.8).tolist()
    assert walk([4] * 5, 6) == [0, 1, 2, 3, 4] and walk([4] * 5, 5) == [0, 0, 2, 2, 4] and walk([4] * 5, 4) == [0] * 5
    assert walk([5, 5, 5, 5, 4], 4) == [0, 0, 2, 2, 4]
    apart = sketch.copy()
    apart[2] = 9
    assert walk([4] * 5, 4, apart) == [0, 0, 2, 0, 0]
    assert forest.climbed(label, np.array([100, 79, 80, 90, 100]), np.full(5, 4), sketch, 4, 0.8).tolist() == [0, 0, 0, 0, 0]
    assert forest.climbed(label[:2], np.array([100, 79]), np.full(2, 4), sketch[:2], 4, 0.8).tolist() == [0, 1]


def test_one_id_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (7, None), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in forest.linked(df).collect()) == [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 0, 7)]


def test_long_words_of_two_letters(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    check(spark.createDataFrame([(1, a), (2, a.translate({97: 98, 98: 97})), (3, f"{a} x"), (4, f"{a}  x")], "doc_id long, text string"))


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in forest.linked(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
