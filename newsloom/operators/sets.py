"""Lists of marks (64-bit hashes of words) of many rows, by mark the rows that hold it.

What a row has in common with all others is a count over the lists of its own marks, so no
pair of rows is gone through word by word. Marks stand for words: among N distinct words
about N**2 / 2**65 pairs share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def marks(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a list column; null is an empty list."""
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


class Sets:
    """Rows from ``start`` on by mark; rows before it are only asked for."""

    def __init__(self, column: pa.ChunkedArray, start: int):
        self.own, self.ends = lists(column)
        self.sizes, self.start = np.diff(self.ends), start
        first = self.ends[start]
        order = np.argsort(self.own[first:], kind="stable")
        self.owner = np.repeat(np.arange(len(self.sizes) - start), self.sizes[start:])[order]
        mark = self.own[first:][order]
        new = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else np.empty(0, np.int64)
        self.mark, self.bounds = mark[new], np.append(new, len(mark))

    def with_all(self, row: int) -> np.ndarray:
        """Of a row with each from start on: how many marks are common."""
        n, own = len(self.sizes) - self.start, self.own[self.ends[row] : self.ends[row + 1]]
        if not len(own) or not len(self.mark):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.mark, own), len(self.mark) - 1)
        at = at[self.mark[at] == own]
        held = [self.owner[a:z] for a, z in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate(held), minlength=n) if held else np.zeros(n)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of rows, sorted by x, y from start on: how many marks they share."""
        out = np.zeros(len(x), np.int64)
        cuts = [*np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist(), len(x)] if len(x) else []
        n = len(self.sizes) - self.start
        for i, k in zip(cuts, cuts[1:], strict=False):
            if (k - i) * 64 < n:
                own = self.own[self.ends[x[i]] : self.ends[x[i] + 1]]
                out[i:k] = [len(np.intersect1d(own, self.own[self.ends[r] : self.ends[r + 1]], assume_unique=True)) for r in y[i:k].tolist()]
            else:
                out[i:k] = self.with_all(int(x[i]))[y[i:k] - self.start]
        return out

    def jaccards(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """0 where both sets are empty."""
        common = self.common(x, y)
        either = self.sizes[x] + self.sizes[y] - common
        return np.where(either > 0, common / np.maximum(either, 1), 0.0)
