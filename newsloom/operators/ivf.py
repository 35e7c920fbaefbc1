"""An inverted-file index for approximate nearest neighbours.

Cells are fitted by k-means on a bounded sample of rows; every row is indexed, in a table
partitioned by cell, so a search scans only the cells that its queries probe. With
``probes`` equal to the number of cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import vector as V

SAMPLE = 20_000  # rows that cells are fitted on at most


def _units(column) -> np.ndarray:
    x = np.array(column.tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cells(corpus: DataFrame, n: int, rounds: int = 10, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of spherical k-means on the first rows in the order of a seeded hash."""
    rows = corpus.orderBy(F.xxhash64(F.lit(seed), "news_id"), "news_id").limit(sample).select(V.doubles(F.col("embedding")).alias("embedding")).toPandas()
    x = _units(rows["embedding"])
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == k].sum(0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def indexed(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(news_id, embedding, cell) of every row; write it with partitionBy("cell")."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["cell"] = (_units(pdf["embedding"]) @ centroids.T).argmax(1) if len(pdf) else []
            yield pdf

    return corpus.select(F.col("news_id").cast("string"), V.doubles(F.col("embedding")).alias("embedding")).mapInPandas(assign, "news_id string, embedding array<double>, cell int")


def nearest(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, news_id, score, rank): the best k in the ``probes`` cells closest to each query."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(_units(pdf["query"]) @ centroids.T), axis=1, kind="stable")[:, :probes]
                yield pdf.loc[pdf.index.repeat(near.shape[1])].assign(cell=near.ravel())

    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", V.doubles(F.col("query")).alias("query")).mapInPandas(probe, f"query_id {kind}, query array<double>, cell int")
    found = asked.join(index, "cell").withColumn("score", V.cosine(F.col("query"), F.col("embedding")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "news_id"))
    return found.select("query_id", "news_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, and the share of the true neighbours (query_id, news_id) that were found."""
    x = truth.select("query_id", "news_id").join(found.select("query_id", "news_id", F.lit(1).alias("hit")), ["query_id", "news_id"], "left")
    return x.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
