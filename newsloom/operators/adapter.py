"""Contrastive training of a projection adapter over frozen vectors.

An adapter is one matrix, first the identity: a vector is multiplied by it and brought to
unit length. Pairs of the same story are pulled together, pairs of different ones pushed
under a margin. Each round sums the gradient of all training pairs in Arrow tasks, as
whole numbers, so the sum is the same however pairs are dealt and whichever task is run
again; one matrix for each task comes back. Rounds end when the loss on the validation pairs
has not fallen for ``patience`` rounds, and the best matrix is kept. What encoders do on
GPUs is left to them: this trains on the vectors they give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import materialise

UNIT = 1 << 32  # of the fixed-point sums
PART = 256  # pairs whose gradients are rounded at once


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _losses(w: np.ndarray, x: np.ndarray, y: np.ndarray, same: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient by w) of each pair."""
    u, v = x @ w, y @ w
    nu, nv = np.maximum(np.linalg.norm(u, axis=1), 1e-12)[:, None], np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    u, v = u / nu, v / nv
    c = np.einsum("ij,ij->i", u, v)[:, None]
    push = np.where(same[:, None], -1.0, (c > margin).astype(float))
    du, dv = push * (v - c * u) / nu, push * (u - c * v) / nv
    loss = np.where(same, 1 - c[:, 0], np.maximum(c[:, 0] - margin, 0))
    return loss, np.einsum("ni,nj->nij", x, du) + np.einsum("ni,nj->nij", y, dv)


def _sums(pairs: DataFrame, w: np.ndarray, margin: float, gradient: bool) -> tuple[float, int, np.ndarray]:
    """(loss, pairs, gradient) over all pairs (a, b, same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0, 0, np.zeros(w.shape, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, PART):
                own = b.slice(at, PART)
                l, g = _losses(w, _matrix(own.column("a")), _matrix(own.column("b")), own.column("same").to_numpy(zero_copy_only=False).astype(bool), margin)
                loss += int(np.round(l * UNIT).astype(np.int64).sum())
                n += own.num_rows
                if gradient:
                    total += np.round(g * UNIT).astype(np.int64).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"loss": pa.array([loss], pa.int64()), "n": pa.array([n], pa.int64()), "g": pa.array([total.tobytes()], pa.binary())})

    found = pairs.mapInArrow(run, "loss long, n long, g binary").collect()  # a matrix for each task
    n = sum(r.n for r in found)
    total = sum((np.frombuffer(r.g, np.int64).reshape(w.shape) for r in found), np.zeros(w.shape, np.int64))
    return sum(r.loss for r in found) / UNIT / max(n, 1), n, total / UNIT / max(n, 1)


def trained(pairs: DataFrame, rounds: int = 40, rate: float = 1.0, margin: float = 0.3, patience: int = 4, fold: int = 5) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(matrix, [(training loss, validation loss) of each round]) from pairs (id_a, id_b, a, b, same); one in ``fold`` by a hash of the ids validates."""
    vector = lambda c: F.col(c).cast("array<double>").alias(c)
    own = materialise(pairs.where("a IS NOT NULL AND b IS NOT NULL").select(vector("a"), vector("b"), "same", (F.pmod(F.xxhash64("id_a", "id_b"), F.lit(fold)) == 0).alias("validates")))
    first = own.select("a").limit(1).collect()
    if not first:
        raise ValueError("there are no pairs to train on")
    w = np.eye(len(first[0].a))
    train, check = own.where("NOT validates").drop("validates"), own.where("validates").drop("validates")
    best, told, since = (np.inf, w), [], 0
    for _ in range(rounds):
        loss, _, g = _sums(train, w, margin, True)
        seen, n, _ = _sums(check, w, margin, False)
        seen = seen if n else loss
        told.append((loss, seen))
        if seen < best[0] - 1e-6:
            best, since = (seen, w), 0
        else:
            since += 1
            if since >= patience:
                break
        w = w - rate * g * len(w)  # gradients of unit vectors fall with their length
    return best[1], told


def layers(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The adapter as layers for ``sources.encoders.adapted``."""
    return [(w, np.zeros(w.shape[1]))]


def pairs_of(rows: DataFrame, story: str, negatives: DataFrame, most: int = 20) -> DataFrame:
    """(id_a, id_b, a, b, same): each row with the ``most`` rows after it in its story at most, and the given hard negatives (a, b).

    rows: (row_pos, story, embedding). A story of n rows gives no more than n * most pairs.
    """
    from pyspark.sql import Window

    own = rows.select("row_pos", F.col(story).alias("story"), "embedding")
    ahead = F.collect_list("row_pos").over(Window.partitionBy("story").orderBy("row_pos").rowsBetween(1, most))
    same = own.withColumn("next", ahead).select(F.col("row_pos").alias("id_a"), F.explode("next").alias("id_b"), F.lit(True).alias("same"))
    both = same.union(negatives.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.lit(False)))
    v = lambda c: own.select(F.col("row_pos").alias(f"id_{c}"), F.col("embedding").alias(c))
    return both.join(v("a"), "id_a").join(v("b"), "id_b").select("id_a", "id_b", "a", "b", "same")
