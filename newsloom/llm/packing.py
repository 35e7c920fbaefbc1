"""Operator 9: vector best-fit packing of documents into sequences.

A document's ids are cut into pieces of at most ``capacity`` tokens; full pieces are
sequences of their own. The others are dealt into blocks of about BLOCK pieces by a hash
and packed there, longest first. A bin has three residual capacities (tokens, documents,
attention cost, the sum of squared lengths); among the bins that can take a piece under
every constraint, the one with the best score gets it: the weighted dot product of demand
and residual, or the weighted norm of what would be left. A weight on tokens makes either
one best fit. Every bin with room can win: reading stops only where a bound on the score proves it.
The bins that a block leaves less than GOOD full are opened again and packed in fewer
blocks, round by round, until one block is left or a round has freed less than GAIN of the
bins that came into it. No task ever holds more than a block.

Defined results: a null or empty text is the end id alone; repeated rows (equal doc_id)
are documents of their own, told apart by the column ``copy``, and so are rows without
doc_id; very long texts are encoded whole and cut into pieces; extra columns are ignored;
an empty table gives no row; blocks are deterministic, so a lost task gives the same bins again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_runs, materialise, slices
from .tokens import PieceEncoder

CAPACITY, BLOCK, GOOD = 2048, 50_000, 0.97
GAIN = 0.001  # of its bins that a round has to free for another one
KNOWN = 300_000  # pieces that a worker remembers


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32) of every document's pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(vocabulary)
        encoder.limit = KNOWN
        end = np.array([end_id], "<u4")
        for b in batches:
            for at, texts in slices(b.column("text")):
                rows, (all_, counts) = [], encoder.many(texts)
                ends = np.cumsum(counts)
                for doc, copy, a, z in zip(*(b.column(c).slice(at, len(texts)).to_pylist() for c in ("doc_id", "copy")), (ends - counts).tolist(), ends.tolist(), strict=True):
                    ids = np.concatenate([all_[a:z].astype("<u4"), end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc, copy, k, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text")
    return own.mapInArrow(encode, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins in order of their residual tokens, with the residuals of all three limits."""

    def __init__(self, limits: tuple[int, int, int], weights: tuple[float, float, float], norm: bool):
        self.limits, self.weights, self.norm = (np.array(x, np.float64) for x in (limits, weights, norm))
        self.held = np.empty((4, 64))  # residual tokens, documents and cost, and the bin's number
        self.open = self.n = 0

    def _scores(self, left: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Lower is better; left has a column for each bin."""
        r, d, w = left / self.limits[: len(left), None], (need / self.limits)[: len(left), None], self.weights[: len(left), None]
        return (w * (r - d) ** 2 if self.norm else w * r * d).sum(0)

    def _best(self, need: np.ndarray) -> int | None:
        """The open bin of the best score among all with room.

        Bins are read from the tightest on. The score's share of tokens only grows along
        them and the other shares are never negative, so reading ends where that share
        alone is no better than the best score: no bin beyond can win.
        """
        at, step, best, where = int(np.searchsorted(self.held[0, : self.open], need[0])), 256, np.inf, None
        while at < self.open:
            left = self.held[:3, at : min(at + step, self.open)]
            score = np.where((left[1] >= need[1]) & (left[2] >= need[2]), self._scores(left, need), np.inf)
            k = int(score.argmin())
            if score[k] < best:
                best, where = score[k], at + k
            at += left.shape[1]
            if at < self.open and self._scores(self.held[:1, at : at + 1], need)[0] >= best:
                break
            step *= 2
        return where

    def put(self, length: int) -> int:
        """The bin that takes a piece."""
        need = np.array([length, 1, length * length], np.float64)
        where = self._best(need)
        if where is None:
            number, left = self.n, self.limits - need
            self.n += 1
        else:
            number, left = int(self.held[3, where]), self.held[:3, where] - need
            self.held[:, where : self.open - 1] = self.held[:, where + 1 : self.open]
            self.open -= 1
        if left[0] > 0 and left[1] > 0:
            if self.open == self.held.shape[1]:
                self.held = np.concatenate([self.held, np.empty_like(self.held)], 1)
            at = int(np.searchsorted(self.held[0, : self.open], left[0], side="right"))
            self.held[:, at + 1 : self.open + 1] = self.held[:, at : self.open]
            self.held[:, at] = *left, number
            self.open += 1
        return number


def packed(parts: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), norm: bool = True, block: int = BLOCK) -> DataFrame:
    """The pieces with sequence_id and offset. Constraints left out can never bind."""
    limits = (capacity, max_documents or capacity, max_cost or capacity * capacity)
    columns = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
    kinds = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"

    def pack(t: pa.Table) -> Iterator[pa.RecordBatch]:
        length = t.column("length").to_numpy()
        bins, own = Bins(limits, weights, norm), np.empty(len(length), np.int64)
        for i in np.argsort(-length, kind="stable").tolist():
            own[i] = bins.put(int(length[i]))
        order = np.argsort(own, kind="stable")
        full = np.bincount(own, weights=length).astype(np.int64)
        before = np.cumsum(length[order]) - length[order]
        starts = np.concatenate([[0], np.cumsum(full)[:-1]])
        out = t.take(pa.array(order)).select(columns)
        out = out.append_column("bin", pa.array(own[order])).append_column("offset", pa.array((before - starts[own[order]]).astype(np.int64))).append_column("fill", pa.array(full[own[order]]))
        yield from out.combine_chunks().to_batches()

    done: DataFrame | None = None
    left, level, before = parts, 0, 0
    n = left.count()
    while True:
        blocks = max(1, -(-n // block))
        dealt = left.withColumn("_block", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(level)), F.lit(blocks)).cast("int"))
        now = in_runs(dealt, ["_block"], ["length", "doc_id", "copy", "piece"], lambda t: ((b.append_column("_block", pa.array([t.column("_block")[0].as_py()] * b.num_rows, pa.int32()))) for b in pack(t)), f"{kinds}, bin long, offset long, fill long, _block int", min(blocks, 4096))
        now = materialise(now)
        loose = now.where(F.col("fill") < GOOD * capacity)
        m = loose.count()
        bins = loose.select("_block", "bin").distinct().count()
        freed = before - now.select("_block", "bin").distinct().count() if before else None
        last = blocks == 1 or m == 0 or freed is not None and freed <= GAIN * before  # of the bins that came into this round
        before = bins
        good = now if last else now.where(F.col("fill") >= GOOD * capacity)
        good = good.select(*columns, ((F.lit(level).cast("long") * F.lit(1 << 56)) + F.col("_block").cast("long") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
        done = good if done is None else done.union(good)
        if last:
            return done
        left, level, n = loose.select(*columns), level + 1, m
