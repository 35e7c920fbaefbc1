import hashlib

import pytest

from newsloom.llm import naming

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def expected(rows):
    """(doc_id, keep_id, size, sha256) of each row, and how many rows each text keeps."""
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(d)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    own = [((t or "").translate(UPPER), d) for d, t in rows]
    return sorted(((d, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for t, d in own), key=repr), groups


def check(docs, **how):
    out = naming.deduplicated(docs, **how).collect()
    want, groups = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    names = {}
    for r in out:
        assert names.setdefault((r.level, r.name), r.text_sha256) == r.text_sha256
    assert len(names) == len(groups)
    return out


def test_whole_table(small):
    check(small)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_small_blocks_have_many_levels(small, block):
    docs = small.where("doc_id < 120").selectExpr("doc_id", "substring(text, 1, 300) text")
    out = check(docs.union(docs.selectExpr("doc_id + 1000", "concat(text, 'x')")).union(docs.selectExpr("doc_id + 2000", "upper(text)")), block=block)
    assert max(r.level for r in out) >= 3


def test_edges(edge, none):
    check(edge)
    check(edge, block=16)
    assert naming.deduplicated(none).collect() == []


def test_hot_group_and_missing_ids(spark):
    rows = [(None if i % 5 == 0 else i % 900, "one text of very many rows" if i % 3 else f"text {i % 40}") for i in range(4000)] + [(None, "only without id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(docs, block=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_marks_of_different_blocks(spark):
    rows = [(i, f"text {i % 50} " * (1 + i % 3)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def few(block, seed):  # three marks at first: they do meet at edges
        return naming.hashed(block, seed) % (3 if seed == 0 else 1 << 40)

    check(docs, mark=few)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        check(docs, mark=lambda block, seed: 5)  # one partition: the bytes decide
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(RuntimeError):
        naming.deduplicated(docs, mark=lambda block, seed: 5)
