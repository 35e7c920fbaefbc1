"""Encoders of texts and adapters of vectors, as Arrow-batched functions over any model.

A model is made once in each Python worker by a factory, so it may be large; it maps a list
of texts to a matrix of one row for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], np.ndarray]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _unit(x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), least)


def _vectors(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if x.ndim > 1 else 0)), flat)


def encoded(rows: DataFrame, factory: Callable[[], Model], text: str = "model_text", batch: int = 16, normalise: bool = True) -> DataFrame:
    """(news_id, embedding) of rows; a null text is encoded as an empty one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            parts = [np.asarray(model(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
            if parts:
                x = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([b.column("news_id"), _vectors(_unit(x) if normalise else x)], names=["news_id", "embedding"])

    return rows.select(F.col("news_id").cast("string"), F.col(text).alias("text")).mapInArrow(encode, "news_id string, embedding array<float>")


def letters() -> Model:
    """A model without weights: how often each Latin letter stands in a text."""
    return lambda texts: np.array([[t.count(c) for c in LETTERS] for t in texts], float)


def adapted(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(news_id, embedding): vectors through a multilayer projection, ReLU between layers, of unit length."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("embedding").to_pylist(), float)
            for i, (w, bias) in enumerate(layers):
                x = x @ w + bias
                if i + 1 < len(layers):
                    x = np.maximum(x, 0)
            yield pa.RecordBatch.from_arrays([b.column("news_id"), _vectors(_unit(x))], names=["news_id", "embedding"])

    return rows.select(F.col("news_id").cast("string"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(project, "news_id string, embedding array<float>")
