"""Helpers that the training-data operators share.

Words are runs of characters other than space and U+0009..U+000D everywhere in
this subpackage. ``bytes.split()`` splits at exactly those characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.components import checkpoint_root, components, materialise  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/newsloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    df.write.parquet(path := shared_folder(df.sparkSession))
    return df.sparkSession.read.parquet(path)


def slices(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Consecutive pieces of a string column of about max_bytes each, with their offsets."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, len(column)
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield at, column.slice(at, stop - at).to_pylist()
        at = stop


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # of the first k bytes of eight
_LONG = 512  # bytes; longer words are hashed one by one


class Words:
    """The words of many texts: 64-bit hashes, places in ``raw``, and the number and bytes of each text.

    A word is read eight bytes at a time, all words at once, and each eight bytes are mixed
    into its hash. That mixing is a bijection, so words of equal length up to eight bytes
    never share a hash; longer ones do with a chance of 2^-64 for a pair. ``same`` compares bytes.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.raw = b"\n".join([*parts, b""])
        if lower:
            self.raw = self.raw.lower()
        space = np.ones(len(self.raw) + 1, bool)
        space[1:] = _SPACE[np.frombuffer(self.raw, np.uint8)]
        edge = np.flatnonzero(space[1:] != space[:-1])  # begins and ends in turn, as raw ends with white space
        self.start, self.end = edge[::2], edge[1::2]
        self._eight = np.ndarray((len(self.raw) + 1,), "<u8", self.raw + bytes(8), strides=(1,))
        self._head = self._lane(np.arange(len(self.start)), 0)
        self.hash = self._hashes()
        self.sizes = np.array([len(x) for x in parts], np.int64)
        limits = np.cumsum(self.sizes + 1)
        self.counts = np.diff(np.concatenate([[0], np.searchsorted(self.start, limits)])) if len(parts) else np.empty(0, np.int64)

    def _lane(self, i: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of the words i, zeros after their ends."""
        at = self.start[i] + 8 * k
        return self._eight[at] & _MASKS[np.minimum(self.end[i] - at, 8)]

    def _hashes(self) -> np.ndarray:
        n = self.end - self.start
        h = mixed(n.astype(U64) * U64(0x9E3779B97F4A7C15))
        live, k = np.flatnonzero(n <= _LONG), 0
        while len(live):
            h[live] = mixed(h[live] ^ (self._lane(live, k) if k else self._head[live]))
            k += 1
            live = live[n[live] > 8 * k]
        for i in np.flatnonzero(n > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.word(i))
        return h

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words i and the words j have the same bytes, pair by pair."""
        n = self.end[i] - self.start[i]
        out = (n == self.end[j] - self.start[j]) & (self._head[i] == self._head[j])
        live, k = np.flatnonzero(out & (i != j) & (n > 8) & (n <= _LONG)), 1
        while len(live):
            equal = self._lane(i[live], k) == self._lane(j[live], k)
            out[live[~equal]] = False
            k += 1
            live = live[equal & (n[live] > 8 * k)]
        for x in np.flatnonzero(out & (i != j) & (n > _LONG)).tolist():
            out[x] = self.word(int(i[x])) == self.word(int(j[x]))
        return out

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits depend on all bits of x."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive word hashes, by doubling; each step mixes, so none is linear."""
    if len(h) < k:
        return np.empty(0, U64)
    join = lambda a, b: mixed(a * U64(0x9E3779B97F4A7C15) ^ b)
    out, size, power = None, 0, [(h, 1)]
    while power[-1][1] * 2 <= k:
        p, n = power[-1]
        power.append((join(p[:-n], p[n:]), 2 * n))
    for p, n in reversed(power):
        if k - size >= n:
            part = p[size : size + len(h) - k + 1]
            out = mixed(part) if out is None else join(out, part)
            size += n
    return out


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1, most: int = 0) -> Iterator[pa.Table]:
    """Tables of equal keys with at least ``least`` rows, from batches sorted by the keys. A run may span batches.

    With ``most``, a run of more rows comes in pieces of about that many; each piece begins
    with the run's first row and has ``split`` in its schema's metadata.
    """
    held: list[pa.RecordBatch] = []
    first: pa.RecordBatch | None = None  # of a run that has been split

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    def piece() -> pa.Table:
        own = pa.Table.from_batches([first, *held])
        return own.replace_schema_metadata({"split": "1"})

    def whole() -> Iterator[pa.Table]:
        nonlocal first
        if first is not None:
            if held:
                yield piece()
        elif held and sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
        held.clear()
        first = None

    def more(b: pa.RecordBatch) -> Iterator[pa.Table]:
        nonlocal first
        held.append(b)
        while most and sum(x.num_rows for x in held) > most:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            new = first is None
            first = rows.slice(0, 1) if new else first
            held[:] = [rows.slice(int(new), most)]
            yield piece()
            rest = rows.slice(int(new) + most)
            held[:] = [rest] if rest.num_rows else []

    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            if b.num_rows > 1:
                here, before, gone = c.slice(1), c.slice(0, b.num_rows - 1), c.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= pa.compute.not_equal(here, before).fill_null(False).to_numpy(zero_copy_only=False) | (gone[1:] != gone[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new)])
        sizes = np.diff(np.append(starts, b.num_rows))
        last = held[-1] if held else first
        if last is not None and key(last, last.num_rows - 1) != key(b, 0):
            yield from whole()
        yield from more(b.slice(0, int(sizes[0])))
        if len(starts) == 1:
            continue
        yield from whole()
        for i in (np.flatnonzero(sizes[1:-1] >= least) + 1).tolist():
            yield from more(b.slice(int(starts[i]), int(sizes[i])))
            yield from whole()
        yield from more(b.slice(int(starts[-1])))
    yield from whole()


def in_runs(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, n: int | None = None, least: int = 1, most: int = 0) -> DataFrame:
    """Apply f to the rows of each key that has at least ``least``, sorted by keys and order; many small keys share a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, keys, least, most):
            yield from f(run)

    return df.repartition(n or partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def buffered(out: Iterable[dict[str, list]], schema: pa.Schema, rows: int = 5000) -> Iterator[pa.RecordBatch]:
    """Join small groups of rows to larger record batches."""
    held: dict[str, list] = {n: [] for n in schema.names}
    for part in out:
        for n in schema.names:
            held[n].extend(part[n])
        if len(held[schema.names[0]]) >= rows:
            yield pa.RecordBatch.from_pydict(held, schema=schema)
            held = {n: [] for n in schema.names}
    if held[schema.names[0]]:
        yield pa.RecordBatch.from_pydict(held, schema=schema)


def joined(links: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix reaches."""
    label = np.full(len(links), -1, np.int64)
    for i in range(len(links)):
        if label[i] < 0:
            seen = np.zeros(len(links), bool)
            seen[i] = True
            edge = seen
            while edge.any():
                reached = links[edge].any(0)
                edge = reached & ~seen
                seen |= reached
            label[seen] = i
    return label


def min_labels(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in an edge (a, b): the smallest id it reaches."""
    return components(edges)


def chunked(docs: DataFrame, target: int | Callable[[int], int] = 4 << 20, more: tuple[str, ...] = (), least: int = 16) -> tuple[DataFrame, int, int]:
    """(chunk, doc_id, text, *more) dealt by a hash of doc_id and text, the number of chunks, and the bytes of all texts.

    A chunk holds about ``target`` bytes of text (which may depend on all bytes) and is the same set of documents
    whenever it is made and whatever the session's settings are, so a lost task or a
    second pass sees what the first one saw.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(least, -(-size // (target(size) if callable(target) else target)))
    out = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long"), "text", *more)
    return out.repartition(partitions(docs.sparkSession), "chunk"), chunks, size
