"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and reads it back as the next one's input.

Defined results: rows that share a doc_id or have none are documents of their own in every
stage: each is judged, linked and mixed by its own text, and only rows that are equal in
all columns stand for each other in the mix. Of linked documents with equal doc_ids the
first in the stage's files stays, and one with a doc_id before one without. Null and empty
texts fail the quality rules; very long texts pass through every stage whole; columns
other than those of ``documents`` are dropped at the start, so no name can clash; empty
tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import forest, mixing, packing, quality, substrings
from newsloom.llm.common import materialise, table, written
from newsloom.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; rows are told apart by their place in the stage's files."""
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"))
    groups = materialise(forest.linked(rows.select(F.col("row").alias("doc_id"), "text")).where("n_links > 0").select(F.col("doc_id").alias("row"), "component_id"))
    first = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = groups.join(first.select("first.row"), "row", "left_anti").select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; texts that lose none are unchanged, and documents left without a word go."""
    cut = substrings.deduplicated(docs, as_is=True, more=("lang", "source")).where("n_words > n_removed")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rest = COLUMNS[1:]
    docs = docs.select(*COLUMNS, F.xxhash64(*rest, *[F.col(c).isNull() for c in rest]).alias("mark"))
    taken = mixing.mixed(docs, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    own = docs.dropDuplicates(["doc_id", "mark"]).join(taken.toDF("id", "own_mark", "copies"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own_mark")))
    return own.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.packed(materialise(packing.pieces(docs, vocabulary("word_bpe_49k.json"))))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("mixing sources to target weights", mix), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: The mix draws at random and the packing has no SQL form, so there is no SQL for run().
ORACLE_SQL = None
