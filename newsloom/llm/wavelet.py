"""Operator 6: token ids in a wavelet matrix per shard.

Documents are dealt by ranges of doc_id; each task encodes its documents in order and
cuts them into shards of about SHARD ids. A shard is one compressed file that holds its
document index, the bit planes of a wavelet matrix over its ids (ranked by frequency, so
the upper planes are nearly empty) and a count of ones before each block of bits. Access,
rank, select, counting and occurrence lookup work on those planes alone.

File format (little-endian): magic ``NLW2``, u32 documents, u64 ids, u32 distinct ids,
u8 planes, u64 bytes of the index; for each plane from the top u64 zeros and u64 bytes;
the index: i64 doc_id per document, u64 ids up to each document's end, u32 distinct ids by
rank; and the planes: u32 ones before each block of 512 bits, and the bits (least
significant first). The index and each plane are zstd frames of their own, and a reader
opens a plane when it first needs it. Spark writes the files, one shard for each Parquet
file, so any store that Spark can write to will do, and a lost task is simply run again.

Defined results: a null text is empty and has the end id alone; documents with equal
doc_ids stay apart, in the order of a hash of their texts; an empty table gives no shard
and no row; a document longer than a shard is a shard of its own; rows without doc_id come
last (the index has NONE for them, so a doc_id of 2^63 - 1 reads as none); extra columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_folder, slices
from .tokens import PieceEncoder

MAGIC, BLOCK, SHARD = b"NLW2", 512, 1 << 20
NONE = 2**63 - 1


def _bools(bits: np.ndarray, n: int) -> pa.Array:
    return pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])


class WaveletMatrix:
    """Rank/select sequence of small integers, top bit plane first."""

    def __init__(self, n: int, planes: Sequence[np.ndarray], zeros: list[int], before: Sequence[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.before = before if before is not None else [self._counts(p) for p in planes]

    @staticmethod
    def _counts(bits: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK bits."""
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    @classmethod
    def build(cls, x: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = np.packbits(((x >> x.dtype.type(level)) & x.dtype.type(1)).astype(bool), bitorder="little")
            if level == 0:  # nothing below needs the order
                zeros.append(len(x) - int(np.bitwise_count(bits).sum()))
                planes.append(bits)
                break
            one, a = _bools(bits, len(x)), pa.array(x)
            low = a.filter(pc.invert(one)).to_numpy(zero_copy_only=False)
            planes.append(bits)
            zeros.append(len(low))
            x = np.concatenate([low, a.filter(one).to_numpy(zero_copy_only=False)])
        return cls(len(x), planes, zeros)

    def values(self, dtype: np.dtype) -> np.ndarray:
        """The whole sequence, plane by plane from the bottom."""
        x, i = np.zeros(self.n, dtype), np.arange(self.n, dtype=np.int32 if self.n < 1 << 31 else np.int64)
        for level, (bits, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(bits, count=self.n, bitorder="little")
            if level == 0:
                x = one.astype(dtype)
                continue
            x[z:] |= x.dtype.type(1 << level)
            if (self.n - z) * 8 < self.n:  # few ones: two masked copies are cheaper than a gather
                y, mask = np.empty_like(x), one.view(bool)
                y[~mask] = x[:z]
                y[mask] = x[z:]
                x = y
            else:
                ones = np.cumsum(one, dtype=i.dtype)
                x = x.take(np.where(one, ones + i.dtype.type(z - 1), i - ones))
        return x

    def _ones(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones in the first i bits of a plane."""
        i = np.asarray(i, np.int64)
        bits, out = self.planes[plane], self.before[plane][i // BLOCK].astype(np.int64)
        for k in range(BLOCK // 8):
            at = i // BLOCK * (BLOCK // 8) + k
            left = np.clip(i - at * 8, 0, 8)
            out += np.bitwise_count(bits[np.minimum(at, max(len(bits) - 1, 0))] & ((1 << left) - 1).astype(np.uint8)) if len(bits) else 0
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i, out = np.asarray(i, np.int64), np.zeros(np.shape(i), np.int64)
        for p, z in enumerate(self.zeros):
            bit = self.planes[p][i // 8] >> (i % 8).astype(np.uint8) & 1
            ones = self._ones(p, i)
            i = np.where(bit == 1, z + ones, i - ones)
            out = out * 2 + bit
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """The place of value's first i-prefix occurrences in the bottom order."""
        lo, hi = 0, i
        for p, z in enumerate(self.zeros):
            a, b = (int(self._ones(p, np.array([k]))[0]) for k in (lo, hi))
            lo, hi = (z + a, z + b) if value >> (len(self.zeros) - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often value occurs among the first i."""
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, p: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of this kind in a plane: by block, then by bit."""
        size = len(self.before[p])
        blocks = self.before[p].astype(np.int64) if bit else np.minimum(np.arange(size) * BLOCK, self.n) - self.before[p]
        at = int(np.searchsorted(blocks, k, side="right")) - 1
        part = np.unpackbits(self.planes[p][at * BLOCK // 8 : (at + 1) * BLOCK // 8], bitorder="little")
        return at * BLOCK + int(np.flatnonzero(part == bit)[k - int(blocks[at])])

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of value."""
        i = self._range(value, self.n)[0] + k
        for p in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def locate(self, value: int) -> list[int]:
        """All positions of value."""
        return [self.select(value, k) for k in range(self.count(value))]


class Lazy(Sequence):
    """A sequence whose items are made when they are asked for."""

    def __init__(self, n: int, item: Callable[[int], np.ndarray]):
        self.n, self.item = n, item

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        return self.item(i % self.n)


class Shard:
    """A wavelet matrix over ranked ids, with its documents."""

    def __init__(self, doc_ids: np.ndarray, ends: np.ndarray, alphabet: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.ends, self.alphabet, self.matrix = doc_ids, ends, alphabet, matrix

    @classmethod
    def of(cls, doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> Shard:
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        alphabet = used[np.argsort(-counts[used], kind="stable")].astype(np.uint32)
        rank = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        rank[alphabet] = np.arange(len(alphabet))
        levels = max(1, int(len(alphabet) - 1).bit_length())
        return cls(np.array(doc_ids, np.int64), np.cumsum(lengths, dtype=np.uint64), alphabet, WaveletMatrix.build(rank[ids], levels))

    def dump(self) -> bytes:
        m, c = self.matrix, zstandard.ZstdCompressor(level=-3)
        index = c.compress(self.doc_ids.tobytes() + self.ends.tobytes() + self.alphabet.tobytes())
        planes = [c.compress(before.tobytes() + bits.tobytes()) for bits, before in zip(m.planes, m.before, strict=True)]
        head = struct.pack("<IQIBQ", len(self.doc_ids), m.n, len(self.alphabet), len(planes), len(index))
        table = np.array([[z, len(x)] for z, x in zip(m.zeros, planes, strict=True)], "<u8").tobytes()
        return b"".join([MAGIC, head, table, index, *planes])

    @classmethod
    def load(cls, file: bytes) -> Shard:
        if file[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        docs, n, size, levels, index = struct.unpack_from("<IQIBQ", file, 4)
        at = 4 + struct.calcsize("<IQIBQ")
        table = np.frombuffer(file, "<u8", 2 * levels, at).reshape(-1, 2)
        at += table.nbytes
        raw = zstandard.ZstdDecompressor().decompress(file[at : at + index])
        doc_ids, ends = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<u8", docs, 8 * docs)
        alphabet = np.frombuffer(raw, "<u4", size, 16 * docs)
        edge = (at + index + np.concatenate([[0], np.cumsum(table[:, 1])])).astype(np.int64).tolist()
        blocks = -(-(-(-n // 8)) // (BLOCK // 8)) + 1

        @functools.cache
        def plane(i: int) -> bytes:
            return zstandard.ZstdDecompressor().decompress(file[edge[i] : edge[i + 1]])

        bits = Lazy(levels, lambda i: np.frombuffer(plane(i), "<u1", offset=4 * blocks))
        before = Lazy(levels, lambda i: np.frombuffer(plane(i), "<u4", blocks))
        return cls(doc_ids, ends, alphabet, WaveletMatrix(n, bits, table[:, 0].astype(int).tolist(), before))

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return self.alphabet[self.matrix.values(np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)]

    def _rank(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def count(self, token: int) -> int:
        return 0 if (r := self._rank(token)) is None else self.matrix.count(r)

    def locate(self, token: int) -> list[tuple[int, int]]:
        """(doc_id, position in the document) of each occurrence."""
        if (r := self._rank(token)) is None:
            return []
        at = np.array(self.matrix.locate(r), np.int64)
        doc = np.searchsorted(self.ends, at, side="right")
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        return list(zip(self.doc_ids[doc].tolist(), (at - starts[doc]).tolist(), strict=True))

    def access(self, position: np.ndarray) -> np.ndarray:
        return self.alphabet[self.matrix.access(position)]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard: int = SHARD) -> None:
    """Write all documents (doc_id, text) as shard files below path, in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = PieceEncoder.of(vocabulary), 0
        end = np.array([end_id], encoder.dtype)
        ids, lengths, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            x = Shard.of(ids, lengths, np.concatenate(held))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [number], "first_doc": [ids[0]], "n_tokens": [size], "file": [x.dump()]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            for at, texts in slices(b.column("text"), 8 << 20):
                all_, counts = encoder.many(texts)
                ends = np.cumsum(counts)
                for doc, a, z in zip(b.column("doc_id").slice(at, len(texts)).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    n = z - a + 1
                    if held and size + n > shard:
                        yield out()
                        ids, lengths, held, size, number = [], [], [], 0, number + 1
                    ids.append(NONE if doc is None else doc)
                    lengths.append(n)
                    held += [all_[a:z], end]
                    size += n
        if held:
            yield out()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]  # the hash splits rows that share a doc_id or have none
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    files = ordered.mapInArrow(encode, "part int, shard int, first_doc long, n_tokens long, file binary")
    files.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files below path."""
    shards = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, file in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "file")), strict=True):
                s = Shard.load(file)
                ids = s.ids().astype("<u4", copy=False)
                ends = s.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ends), pa.int32()), "shard": pa.array([number] * len(ends), pa.int32()), "doc_id": pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NONE), "at": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})

    docs = shards.select("part", "shard", "file").mapInArrow(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Ids before each shard: of the range partitions before its own, and of the shards before it in that.
    sizes = materialise(shards.select("part", "shard", "n_tokens"))
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    before = sizes.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("shards_before")).join(by_part, "part")
    return docs.join(before, ["part", "shard"]).select("doc_id", (F.col("parts_before") + F.col("shards_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def stored(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the documents to shard files in the shared folder and read their digests back."""
    path = shared_folder(docs.sparkSession)
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
