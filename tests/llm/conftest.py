import pytest

EDGE = [
    (1, "the cat sat on the mat and the dog lay by the door of the house", "en", "a", 1),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "x " * 40000, "en", "b", 80000),
    (5, "the cat sat on the mat and the dog lay by the door of the house", "en", "a", 1),
    (6, "one\n\ntwo  three \t four\x0bfive\x0csix seven 'll don't <|endoftext|> end", None, "b", None),
    (7, "   \n\t ", "fr", "é", 6),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, copies, and an extra column whose name clashes with an output."""
    return spark.createDataFrame([(*r, 7) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long, n_words int")


@pytest.fixture(scope="session")
def none(spark, edge):
    return edge.where("doc_id < 0")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
