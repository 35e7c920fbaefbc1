import random

from newsloom.llm import substrings


def check(docs):
    want = substrings.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.deduplicated(docs)).collect()}
    assert got == want


def test_documents(small, edge, none):
    check(small)
    check(edge.where("doc_id <> 4"))
    assert substrings.deduplicated(none).collect() == []


def test_random_words(spark):
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(12, 30))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"{i}-{rng.random()}" for _ in range(5)]
        rows.append((rng.choice([i, 1000 - i]), " ".join(w)))
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    # A factor has one source: the earliest document that has each of its windows.
    words, first = {d: t.split() for d, t in rows}, {}
    for d, w in sorted(words.items()):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    spans = [(r.doc_id, s) for r in substrings.deduplicated(df).collect() for s in r.spans]
    assert len({s.source for _, s in spans}) > 5
    for d, s in spans:
        w = words[d][s.start : s.start + s.length]
        assert len(w) == s.length >= 13 and {first[tuple(w[i : i + 13])] for i in range(len(w) - 12)} == {s.source} and s.source < d


def test_long_words_of_two_letters(spark):
    """Words whose polynomial hashes are equal are different words."""
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    check(spark.createDataFrame([(1, " ".join([a] * 14)), (2, " ".join([b] * 14)), (3, " ".join([a, b] * 8)), (4, " ".join([b, a] * 8))], "doc_id long, text string"))


def test_rows_grow_in_proportion():
    rows = lambda size: (size / substrings.side(size)) ** 2
    assert rows(8 << 40) < 1.01 * 4 * rows(2 << 40) and rows(2 << 30) <= (2 << 30) / 1000


def test_spans_and_exact_edges(spark):
    thirteen, twelve = " ".join(f"w{i}" for i in range(13)), " ".join(f"v{i}" for i in range(12))
    rows = [(1, f"a {thirteen} b"), (2, f"c {thirteen} d {twelve}"), (3, f"{twelve} e"), (4, f"{thirteen} {thirteen}"), (5, thirteen), (5, thirteen)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: ([(s.start, s.length) for s in r.spans], r.kept) for r in got}
    assert by[1] == ([], f"a {thirteen} b")
    assert by[2] == ([(1, 13)], f"c d {twelve}")
    assert by[3] == ([], f"{twelve} e")
    assert by[4][1] == ""
    assert by[5] == ([(0, 13)], "")
    assert len(got) == 6
