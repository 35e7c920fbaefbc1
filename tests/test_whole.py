"""Queries over whole tables, on small tables made by hand."""

import __spark_entry__ as entry
from newsloom.plans import curated


def test_news_ids_of_large_and_missing_ids(spark, tmp_path):
    ids = [0, 9_999_999, 10_000_000, 123_456_789_012, None]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.news_id for r in entry.queries()["p01_news_ids"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((None if i is None else str(i) for i in ids), key=str)


def test_reference_places_are_ranks_in_the_whole_table(spark, tmp_path, monkeypatch):
    """The rank is taken over all rows, by a range sort."""
    ranked_rows, ranked = [], curated.ranked
    monkeypatch.setattr(curated, "ranked", lambda rows, *a, **b: ranked_rows.append(rows.count()) or ranked(rows, *a, **b))
    ids = [600, 3, None, 499, 500, 10_000_000]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: (r.place, r.quality) for r in entry.queries()["j25_reference_order"](spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {3: (1, 1), 499: (2, None), 500: (3, None), 600: (4, None), 10_000_000: (5, None)} and ranked_rows == [len(ids)]
