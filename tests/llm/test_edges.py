"""Missing and repeated ids, very long words and texts, for every operator."""

import hashlib
import math
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm import counting, forest, licenses, mixing, naming, packing, quality, repair, scoring, subspaces, substrings, wand, wavelet
from newsloom.llm.common import materialise
from newsloom.llm.tokens import vocabulary

BYTE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def alternating(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


A, B = alternating(2048)
LONG = " ".join(f"word{i % 500} and more, it's {i}" for i in range(6000))
ROWS = [
    (None, "a text without an id, which is the first of two such texts"), (None, "a text without an id, which is the second of two such texts"), (None, None),
    (1, "one id and one text that stands here for the first time today"), (1, "one id and quite another text that has other words in it"), (1, "one id and one text that stands here for the first time today"),
    (2, f"{A} {B} {A}"), (3, f"{B} {A} {B}"), (4, LONG), (5, ""), (6, A * 40),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names clash with results."""
    extra = ["source string", "size int", "target string", "key int", "mark int", "chunk int", "score int", "kept int", "n_tokens int", "copy int", "piece int", "component_id int"]
    rows = [(d, t, None if i % 3 == 0 else "s", *[7 if " int" in e else "x" for e in extra[1:]]) for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(extra))


def by_text(rows, docs):
    """Each row's ids and texts as a sorted list, whatever the order of rows with one id."""
    return sorted(map(repr, rows)) == sorted(map(repr, docs))


def test_mixing_keeps_every_row(odd):
    rows = mixing.mixed(odd).collect()
    assert by_text([(r.doc_id, r.size) for r in rows], [(d, len((t or "").split())) for d, t in ROWS])
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_forest_leaves_out_rows_without_id(odd):
    rows = sorted((r.doc_id, r.n_links, r.component_id, r.kept) for r in forest.linked(odd).collect())
    assert rows == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]


def test_substrings_keep_what_only_one_id_has(odd):
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.deduplicated(odd)).collect()]
    want = [(d, len((t or "").split()), 0, hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest()) for d, t in ROWS]
    own = [i for i, (d, _) in enumerate(ROWS) if d is None]
    assert by_text([r for r in rows if r[0] is not None], [w for i, w in enumerate(want) if i not in own])
    assert sorted(r[1] for r in rows if r[0] is None) == sorted(want[i][1] for i in own)


def test_token_ids_of_odd_texts(odd):
    import numpy as np

    library, words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORDS)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS}
    assert by_text([(r.doc_id, r.n_tokens) for r in counting.counted(odd, BYTE).collect()], [(d, len(ids[t])) for d, t in ROWS])
    crc = lambda x: zlib.crc32(np.array([*x, 0], "<u4").tobytes())
    assert by_text([(r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.stored(odd, BYTE).collect()], [(d, len(ids[t]) + 1, crc(ids[t])) for d, t in ROWS])
    rows = packing.packed(materialise(packing.pieces(odd, WORDS))).collect()
    pieces = []
    for d, t in ROWS:
        x = np.array([*words.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(d, k, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(x), 2048))]
    assert by_text([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], pieces)


def test_scores_of_odd_texts(odd):
    rows = scoring.scored(odd, BYTE).collect()
    assert by_text([(r.doc_id, r.n_tokens) for r in rows], [(d, len((t or "").split()) + 1) for d, t in ROWS])
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)


def test_native_operators_on_odd_rows(odd, spark):
    assert by_text([(r.doc_id, r.n_words) for r in quality.judged(odd).collect()], [(d, len((t or "").split())) for d, t in ROWS])
    assert licenses.scan(odd).collect() == []


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(d, t, "en", None if i % 3 == 0 else "s", i) for i, (d, t) in enumerate(ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {d for d, _ in ROWS} and out


def test_naming_keeps_one_row_of_each_text(odd):
    rows = naming.deduplicated(odd).collect()
    assert by_text([(r.doc_id, r.group_size) for r in rows], [(d, sum((u or "") == (t or "") for _, u in ROWS)) for d, t in ROWS])
    assert sum(r.kept for r in rows) == len({t or "" for _, t in ROWS})


def test_search_among_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, "identical words: one text", 7), (1, None, 7), (None, "quite another", 7)], "item_id long, text string, score int")
    out = wand.ranked_documents(odd, items).collect()
    assert {r.item_id for r in out} == {1, None} and all(r.score > 0 for r in out)
    assert sorted(r.rank for r in out if r.item_id is None)[:1] == [1]


def test_vectors_with_clashing_names(spark):
    v = [1.0, 0.0] * 8
    rows = [(1, v, "a"), (2, v, "a"), (2, v, "b"), (None, v, "a"), (3, None, "a"), (4, [0.0] * 16, "a"), (5, [float("nan"), *v[1:]], "a"), (6, v, None)]
    df = spark.createDataFrame([(*r, 7, "x", True) for r in rows], "vec_id long, embedding array<double>, label string, n_links int, cell string, kept boolean")
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in subspaces.linked(df).collect() if r.vec_id is not None))
    assert (1, 0, 1) not in out and {x[2] for x in out if x[0] in (1,)} == {1} and (3, 0, 3) in out and (4, 0, 4) in out and (5, 0, 5) in out and (6, 0, 6) in out


def test_repair_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi?", 1, "x", 2), (None, None, None, None, 1, "x", 2)], "conv_id long, turn long, role string, text string, cost int, seen string, mark int")
    assert {r.conv_id for r in repair.repairs(df).collect()} == {1, None}
