"""Operator 13: exact dedup by deterministic block naming.

Each normalised text (A-Z lower-cased) is cut into blocks of BLOCK bytes. All blocks are
sorted, and a block's integer name is its rank among the distinct ones. Then adjacent
names are paired, the pairs are sorted and named the same way, and so on until a text has
one name: level and name together are its identity, and no two texts share one.

Rows with equal keys stand together in the sort, those of finished texts last and by
doc_id, so a group's size and the row that stays are read off in place. Ties are sorted by
row too, so a group of copies with a third of all rows is split over range partitions like
any other rows; each partition reports its first and its last run, and those few rows settle
the runs that go on in the next partition. Blocks are sorted by a 64-bit mark and then by
their bytes, as the sort's samples reach the driver. Equal marks of different blocks are
told apart by the bytes; if such a pair meets at the edge of a partition, the sort is
done again with other marks. A text crosses the network once, as blocks; later levels have
names alone and half as many rows each.

Defined results: a null text counts as empty, and all empty texts are one group; rows that
are equal in all columns or share a doc_id are rows of their own, and of equal largest
doc_ids one row stays; rows without doc_id come before all others, and a group in which no
row has one keeps one row under keep_id null; a very long text is many blocks and no row
holds it after the first step; extra columns are ignored; an empty table gives no row.
Rows are told apart by their place in the scan, so ``docs`` must be read the same way twice
(a table or files; write the result of a random or unordered step first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, slices

BLOCK, TRIES = 4096, 8
NONE = np.iinfo(np.int64).min  # stands for a doc_id that is missing
_LIGHT = ["rid", "pos", "last", "doc_id", "sha"]


def hashed(block: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(block, seed)


def blocks(docs: DataFrame, block: int, mark: Callable[[bytes, int], int], seed: int) -> DataFrame:
    """(rid, pos, last, doc_id, sha, a, b): block b of a text with its mark a; the text's doc_id and sha256 go with its first block."""
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int64()), ("last", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("a", pa.int64()), ("b", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
            for at, texts in slices(batch.column("text")):
                out: list[list] = [[] for _ in schema]
                for rid, doc, text in zip(rids[at:], ids[at:], texts, strict=False):
                    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
                    last = max(-(-len(raw) // block) - 1, 0)
                    for pos in range(last + 1):
                        part = raw[pos * block : (pos + 1) * block] if last else raw
                        head = (doc, hashlib.sha256(raw).digest()) if pos == 0 else (None, None)
                        for column, x in zip(out, (rid, pos, last, *head, mark(part, seed), part), strict=True):
                            column.append(x)
                marks = np.array(out[5], np.uint64).view(np.int64)
                columns = [pa.array(x, f.type) for x, f in zip([*out[:5], marks, out[6]], schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "rid long, pos long, last long, doc_id long, sha binary, a long, b binary")


def runs_in_place(rows: DataFrame, own: list[str], n: int) -> DataFrame:
    """Each row with the run of equal (a, b) it stands in, and two rows more for each partition: its first and its last run.

    ``own`` is what rows are dealt by, in the order of the sort.
    """
    tie = ["done", "doc_id", "rid", "pos"]
    kind = rows.schema["b"].dataType.simpleString()
    out_schema = f"rid long, pos long, last long, doc_id long, sha binary, run long, size long, keep long, top boolean, pid int, piece int, runs long, pure boolean, a long, b {kind}"
    b_type = pa.binary() if kind == "binary" else pa.int64()
    schema = pa.schema([("rid", pa.int64()), ("pos", pa.int64()), ("last", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("run", pa.int64()), ("size", pa.int64()), ("keep", pa.int64()), ("top", pa.bool_()), ("pid", pa.int32()), ("piece", pa.int32()), ("runs", pa.int64()), ("pure", pa.bool_()), ("a", pa.int64()), ("b", b_type)])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, done_runs = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []  # rows of the run that is open, without keys
        key = first = last = before = None  # before: mark of the run before the open one

        def closed(upto: pa.RecordBatch | None, starts: np.ndarray) -> pa.RecordBatch:
            """The held rows and those of ``upto``, whose runs begin at starts (after the held ones)."""
            nonlocal first, last, done_runs
            t = pa.Table.from_batches([*held, *([upto] if upto is not None else [])]).combine_chunks()
            sizes = np.diff(np.append(starts, t.num_rows))
            done = t.column("last").to_numpy() == 0
            ids = t.column("doc_id").to_numpy(zero_copy_only=False) if not t.column("doc_id").null_count else pc.fill_null(t.column("doc_id"), NONE).to_numpy()
            count = np.add.reduceat(done.astype(np.int64), starts)
            keep = np.maximum.reduceat(np.where(done, ids, NONE), starts)
            top = np.zeros(t.num_rows, bool)
            top[starts + sizes - 1] = True
            each = lambda x: np.repeat(x, sizes)
            kept = each(keep)
            columns = [t.column(c).combine_chunks() for c in _LIGHT] + [
                pa.array(each(done_runs + np.arange(len(starts)))), pa.array(each(count)), pa.array(kept, mask=kept == NONE), pa.array(top & done), pa.array(np.full(t.num_rows, pid, np.int32)),
                *[pa.nulls(t.num_rows, f.type) for f in list(schema)[10:]],
            ]
            done_runs += len(starts)
            last = (done_runs - 1, int(count[-1]), int(keep[-1]))
            first = first or (0, int(count[0]), int(keep[0]))
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

        heads: list[tuple] = []  # (mark, key) of the first run, then whether the second has another mark
        pure = [True, True]
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("a").to_numpy(), batch.column("b")
            new = np.ones(batch.num_rows, bool)
            new[1:] = (a[1:] != a[:-1]) | pc.not_equal(b.slice(1), b.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False)
            new[0] = key is None or key != (int(a[0]), b[0].as_py())
            light = batch.select(_LIGHT)
            starts = np.flatnonzero(new)
            for i in starts[:2].tolist():  # what the first two runs begin with
                if len(heads) < 2:
                    heads.append((int(a[i]), b[i].as_py()))
            if len(starts):
                s = int(starts[-1])
                if len(starts) > 1:
                    before = int(a[s - 1])
                elif key is not None:
                    before = key[0]
                size = sum(x.num_rows for x in held)
                inner = starts[:-1] + size
                if size or s:
                    yield closed(light.slice(0, s) if s else None, np.concatenate([[0], inner]) if size else inner)
                held = [light.slice(s)]
            else:
                held.append(light)
            key = (int(a[-1]), b[-1].as_py())
        if held:
            yield closed(None, np.array([0]))
            if done_runs > 1:
                pure = [heads[0][0] != heads[1][0], before != key[0]]
            ends = [(0, *first, heads[0], pure[0]), (1, *last, key, pure[1])][: 1 if done_runs == 1 else 2]
            rows_ = [{"run": r, "size": n_, "keep": None if k == NONE else k, "pid": pid, "piece": p, "runs": done_runs, "pure": ok, "a": x[0], "b": x[1]} for p, r, n_, k, x, ok in ends]
            yield pa.RecordBatch.from_pylist(rows_, schema=schema)

    rows = rows.withColumn("done", F.col("last") == 0).repartitionByRange(n, *own, *tie)
    return rows.sortWithinPartitions("a", "b", *tie).select(*_LIGHT, "a", "b").mapInArrow(flag, out_schema)


def settled(flagged: DataFrame) -> DataFrame:
    """(rid, pos, last, doc_id, sha, name, size, keep, top) from what ``runs_in_place`` gives.

    The window without a key sees two rows of each partition.
    """
    line = Window.orderBy("pid", "piece")
    same = F.col("a").eqNullSafe(F.lag("a").over(line)) & F.col("b").eqNullSafe(F.lag("b").over(line))
    ends = flagged.where("piece IS NOT NULL").withColumn("step", F.when(F.col("piece") == 1, F.col("runs") - 1).otherwise((~same).cast("long")))
    ends = ends.withColumn("name", F.sum("step").over(line)).withColumn("offset", F.col("name") - F.col("run"))
    chain = Window.partitionBy("name")
    at = F.when(F.col("size") > 0, F.struct("pid", "piece"))
    ends = ends.select("pid", "run", "offset", F.sum("size").over(chain).alias("all"), F.max("keep").over(chain).alias("best"), F.max(at).over(chain).eqNullSafe(at).alias("final"))
    offsets = ends.groupBy("pid").agg(F.min("offset").alias("offset"))  # equal for both ends
    rows = flagged.where("piece IS NULL").join(F.broadcast(offsets), "pid").join(F.broadcast(ends.drop("offset")), ["pid", "run"], "left")
    edge = F.col("all").isNotNull()
    return rows.select(*_LIGHT, (F.col("offset") + F.col("run")).alias("name"), F.when(edge, F.col("all")).otherwise(F.col("size")).alias("size"), F.when(edge, F.col("best")).otherwise(F.col("keep")).alias("keep"), (F.col("top") & F.coalesce("final", F.lit(True))).alias("top"))


def clashes(flagged: DataFrame) -> bool:
    """Whether different blocks with one mark meet at the edge of a partition."""
    line = Window.orderBy("pid", "piece")
    pairs = flagged.where("piece IS NOT NULL").select("a", *[F.lag(c).over(line).alias(f"_{c}") for c in ("a", "b", "pid", "pure")], "b", "pid", "pure")
    return bool(pairs.where("a = _a AND pid <> _pid AND NOT (pure AND _pure AND b = _b)").limit(1).count())


def deduplicated(docs: DataFrame, block: int = BLOCK, mark: Callable[[bytes, int], int] = hashed) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, level, name): one row for each row of docs."""
    n = partitions(docs.sparkSession)
    for seed in range(TRIES):
        flagged = materialise(runs_in_place(blocks(docs, block, mark, seed), ["a"], n))
        if not clashes(flagged):
            break
    else:
        raise RuntimeError(f"different blocks share a mark for {TRIES} seeds")
    left = int(flagged.agg(F.max("last")).first()[0] or 0)
    level, out = 0, None
    while True:
        rows = settled(flagged)
        done = rows.where("last = 0").select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("top").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.lit(level).alias("level"), "name")
        out = done if out is None else out.union(done)
        if left == 0:
            return out
        half, odd = F.shiftright("pos", 1), F.col("pos") % 2 == 1
        name = lambda x: F.coalesce(F.max(F.when(x, F.col("name"))), F.lit(0))  # noqa: E731  names begin at 1
        pairs = rows.where("last > 0").groupBy("rid", half.alias("half")).agg(F.max(F.shiftright("last", 1)).alias("last"), F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), name(~odd).alias("a"), name(odd).alias("b"))
        pairs = pairs.withColumnRenamed("half", "pos")
        flagged = materialise(runs_in_place(pairs, ["a", "b"], n))
        left, level = left >> 1, level + 1


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)"""
