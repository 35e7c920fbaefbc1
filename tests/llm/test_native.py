import re

import duckdb

from newsloom.llm import licenses, quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(small, edge, none):
    for docs in (small, edge):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        for r in quality.judged(docs).collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.judged(none).collect() == []


def test_repeats_by_hand(spark):
    texts = ["a b c d e " * 2, "a b c d e f a b c d e", "a a a a a a", "a a a a a", "x\na b c d e\na b c d e\n", "# " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(df.select("doc_id", "text")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_clean_documents_stay(small, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.judged(small).where("n_words >= 20 AND NOT base_failed").join(labels, "doc_id").groupBy("quality").agg({"kept": "count", "n_words": "count"}).collect()
    kept = quality.judged(small).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    by = {(x.quality, x.kept): x["count"] for x in kept}
    assert r and by.get((1, False), 0) <= 0.01 * by[1, True]
    assert by.get((0, True), 0) <= 0.1 * by[0, False]


def test_license_scan(spark, small, edge, none):
    texts = [
        "intro words here. Released under the MIT License. more words follow",
        "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.",
        "LICENSED under\nthe apache license version 2 0",
        "released under the bsd license",
        licenses.TEMPLATES["MIT"].replace("obtaining", "receiving"),
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, license int")
    got = sorted(map(tuple, licenses.scan(df).collect()))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    cur = con.execute(licenses.oracle())
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in ("doc_id", "license", "n_shingles", "first_token", "containment")) for r in cur.fetchall())
    assert got == want
    assert {(r[0], r[1]) for r in got} >= {(0, "MIT-line"), (1, "Apache-2.0"), (2, "Apache-2.0"), (4, "MIT")}
    assert not any(r[0] in (3, 5, 6) for r in got)
    assert licenses.scan(none).collect() == []
    assert licenses.scan(edge).collect() == []
    rows = licenses.scan(small).collect()
    assert {r.doc_id for r in rows} >= {r.doc_id for r in small.where("text LIKE '%Released under the MIT License.%'").select("doc_id").collect()}


def test_every_template_is_found_in_any_place(spark):
    """Templates between other words at even and odd places, and with words altered in one shingle of ten."""
    rows, names = [], sorted(licenses.TEMPLATES)
    for i, n in enumerate(names):
        t = licenses.tokens(licenses.TEMPLATES[n])
        rows += [(4 * i, " ".join(t)), (4 * i + 1, f"x {' '.join(t)} y"), (4 * i + 2, f"x z {' '.join(t)}")]
        rows.append((4 * i + 3, " ".join(w for j, w in enumerate(t) if j % 5)))  # every fifth word is gone
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(names) >= 25
    for i, n in enumerate(names):
        assert {(4 * i + j, n) for j in range(3)} <= got and (4 * i + 3, n) not in got


def test_license_rows_of_one_id(spark):
    text = licenses.TEMPLATES["MIT"]
    df = spark.createDataFrame([(1, text), (1, text), (1, text.replace("FITNESS", "fit")), (None, text), (2, text + " " + text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles) for r in licenses.scan(df).where("license = 'MIT'").collect()), key=str)
    n = len(licenses.grams(text))
    assert got == sorted([(1, n), (1, n - 5), (2, n), (None, n)], key=str)


def test_repeats_do_not_depend_on_hashes(spark, monkeypatch):
    """All windows share a hash: equal ones are still told from others that stand between them."""
    text = "a b c d e x1 x2 x3 x4 x5 a b c d e y1 y2 y3 a b c d e"
    sql = quality.repeated_words("split(text, ' ')").replace("xxhash64(x)", "0L")
    assert spark.createDataFrame([(text,)], "text string").selectExpr(f"{sql} AS n").first().n == 15



def test_vectorised_words():
    import random

    from newsloom.llm import common

    rng = random.Random(9)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x85\xa0aéBZ中b") for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "", "x" * 300_000, "a " * 90_000]
    for lower in (False, True):
        w = common.Words(texts, lower)
        want = [[x.lower() if lower else x for x in common.words_of(t)] for t in texts]
        assert w.counts.tolist() == [len(x) for x in want]
        flat = [x for d in want for x in d]
        assert [w.word(i) for i in range(len(flat))] == flat
        seen = {}
        for h, x in zip(w.hash.tolist(), flat, strict=True):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_runs_span_batches_and_split():
    import random

    import pyarrow as pa

    from newsloom.llm import common

    rng = random.Random(3)
    for _ in range(60):
        keys = sorted(rng.choice([None, 1, 2, 3, 3, 3, 4]) or 0 for _ in range(rng.randint(0, 60)))
        rows = list(enumerate(keys))
        batches, at = [], 0
        while at < len(rows):
            n = rng.randint(1, 9)
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_pydict({"k": pa.array([k for _, k in part], pa.int64()), "v": pa.array([v for v, _ in part], pa.int64())}))
            at += n
        want = {k: [v for v, x in rows if x == k] for k in set(keys)}
        got = [(t.column("k")[0].as_py(), t.column("v").to_pylist()) for t in common.runs(batches, ["k"], 2)]
        assert got == [(k, v) for k, v in sorted(want.items()) if len(v) >= 2]
        pieces: dict = {}
        for t in common.runs(batches, ["k"], 2, 5):
            k, v = t.column("k")[0].as_py(), t.column("v").to_pylist()
            split = bool(t.schema.metadata and b"split" in t.schema.metadata)
            assert len(v) <= 6 and v[0] == want[k][0] and split == (len(want[k]) > 5)
            pieces.setdefault(k, set()).update(v)
        assert pieces == {k: set(v) for k, v in want.items() if len(v) >= 2}
