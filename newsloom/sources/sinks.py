"""Writers: tables, predictions as CSV, keyed merges, numbered batches and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import ledger as L
from newsloom.operators.eda import batches

LABELS = ("significant", "minor", "duplicate")


def table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def predictions(df: DataFrame, path: str) -> None:
    """CSV with timestamps as yyyy-MM-dd HH:mm:ss."""
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def in_batches(df: DataFrame, path: str, size: int, *order: Column) -> None:
    """Numbered folders of at most ``size`` rows in order."""
    batches(df, size, *order).write.mode("overwrite").partitionBy("batch").json(path)


def embeddings(stored: DataFrame, new: DataFrame) -> DataFrame:
    return L.upserted(stored, new, ["news_id", "model_name", "model_revision"])


def state(stored: DataFrame, result: DataFrame) -> DataFrame:
    """Stored state with the values of a result; labels and probabilities are checked."""
    bad = ~F.coalesce(F.col("novelty_label").isin(*LABELS), F.lit(True)) | ~F.coalesce(F.col("p_significant").between(0, 1), F.lit(True))
    checked = result.withColumn("novelty_label", F.when(bad, F.raise_error(F.concat(F.lit("bad label or probability for "), F.col("news_id")))).otherwise(F.col("novelty_label")))
    return L.merged(stored, checked, ["news_id"])


def article_status(articles: DataFrame, result: DataFrame) -> DataFrame:
    """Articles of the result become processed, take its probability as score and lose their error."""
    r = result.select("news_id", F.col("p_significant").alias("_p"), F.lit(True).alias("_done"))
    out = articles.join(r, "news_id", "left")
    return out.select(*[
        F.when(F.col("_done"), "processed").otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("_done"), F.coalesce("_p", c)).otherwise(F.col(c)).alias(c) if c == "novelty_score" else F.when(F.col("_done"), T.json_without(F.col(c), "pipeline_error")).otherwise(F.col(c)).alias(c) if c == "metadata" else F.col(c)
        for c in articles.columns
    ])


def failed(articles: DataFrame, ids: DataFrame, error: str) -> DataFrame:
    """Articles of ids with status error and the message in their metadata."""
    out = articles.join(ids.select("news_id").distinct().withColumn("_hit", F.lit(True)), "news_id", "left")
    return out.select(*[F.when(F.col("_hit"), "error").otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("_hit"), T.json_with(F.col(c), "pipeline_error", F.lit(error))).otherwise(F.col(c)).alias(c) if c == "metadata" else F.col(c) for c in articles.columns])


def messages(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
