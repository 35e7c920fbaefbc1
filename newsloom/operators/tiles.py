"""Similarity joins in blocks of rows: cosines are matrix products, and only pairs above the cut leave a task.

Rows of one topic and time bucket (as wide as the window) are sorted by the pivot nearest
to their vector and the angle to it, and cut into blocks of BLOCK rows. A block keeps its
span of time and the least and greatest angle to each of PIVOTS pivots. Angles obey the
triangle inequality, so two blocks whose angles to a pivot are farther apart than the
angle of the cut hold no pair, and are ruled out, like blocks whose times are too far apart.
Blocks next to each other are sent together: the pairs of blocks left over of two runs of
SPAN blocks are one tile, so a row is sent once for each run that it meets. A task gets
the rows of both runs, and gives (left, right, similarity, days) or what a reducer makes of
them, some rows of the tile at a time. No row of a pair carries a
vector, and a topic with most of all rows is as many tiles as any other rows. Where angles
rule out nothing, rows are sorted by time instead, so that more blocks are too far apart.

Rows without a vector, a time or a value of ``by``, and vectors with a component that is not
a number, meet nothing; vectors meet those of their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import vector as V

from .components import materialise

DAY = 86_400_000_000
BLOCK, PIVOTS = 512, 8
SPAN = 32  # blocks that are sent together
AT_ONCE = 1 << 21  # cosines that a task holds at once
RUN = 1 << 26  # bytes of further columns in the blocks that are sent together
#: (ids of left rows, of right rows, similarities, days) of a tile to columns of its result.
Reducer = Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray], pa.Table]
#: Similarities of the rows from one place to another, instead of cosines, with all rows of the tile's second part, or with those from the first place on if there is one part (only pairs in order count).
Scores = Callable[[int, int], np.ndarray]
#: Further columns of pairs: places in the first part (ascending), in the second part, of left rows, of right rows.
Also = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, pa.Array]]
#: A tile's rows with their further columns, and where its second part begins (0: it is the first one), to both.
Look = Callable[[pa.Table, int], tuple[Scores | None, Also | None]]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _one(t: pa.Table) -> bool:
    """Whether a tile is of one run with itself; of two runs, either may have no row left."""
    return t.column("i")[0] == t.column("j")[0]


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot; 0 everywhere for vectors of another length than the pivots', which rules out nothing."""
    if units.shape[1] != pivots.shape[1]:
        return np.zeros((len(units), len(pivots)))
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _pivots(rows: DataFrame) -> np.ndarray:
    """PIVOTS vectors of the data, those of least hash; which ones does not change any result."""
    found = rows.select(F.xxhash64("key").alias("h"), "unit").orderBy("h").limit(PIVOTS).collect()
    size = len(found[0].unit) if found else 1
    return np.array([r.unit for r in found if len(r.unit) == size]).reshape(-1, size)


def _cut(rows: DataFrame, by: list[str], most: int, in_time: bool) -> DataFrame:
    """The rows with their block, and a row of bounds (n set) for each block; in_time: blocks follow each other in (at, key)."""
    pivots = np.empty((0, 0)) if in_time else _pivots(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.zeros((b.num_rows, max(len(pivots), 1)))
            same = b.column("unit").value_lengths().to_numpy() == pivots.shape[1]
            if len(pivots):
                a[same] = _angles(_matrix(b.column("unit").filter(pa.array(same))), pivots)
            yield b.append_column("cell", pa.array(a.argmin(1).astype(np.int32))).append_column("angle", pa.array(a.min(1)))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = rows if in_time else rows.mapInArrow(place, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", cell int, angle double")
    groups = [*by, "dim", "bucket", "side"]
    out = ", ".join(f"`{n}` {kinds[n]}" for n in [*groups, "key", "at", "unit"]) + ", block long, n int, low long, high long, least array<double>, most array<double>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []

        def block() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            at, a = t.column("at").to_numpy(), _angles(_matrix(t.column("unit").combine_chunks()), pivots)
            odd = np.isnan(a)
            number = pa.array(np.full(t.num_rows, base + count))
            none = [pa.nulls(t.num_rows, k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))]
            names = [*t.column_names, "block", "n", "low", "high", "least", "most"]
            yield from pa.Table.from_arrays([*t.columns, number, *none], names=names).to_batches()
            own = t.slice(0, 1)
            bounds = [pa.array([t.num_rows], pa.int32()), pa.array([at.min()]), pa.array([at.max()]), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in (np.where(odd, -np.inf, a).min(0), np.where(odd, np.inf, a).max(0))]]
            head = [own.column(c) if c in groups else pa.nulls(1, own.column(c).type) for c in t.column_names]
            yield from pa.Table.from_arrays([*head, number.slice(0, 1), *bounds], names=names).to_batches()

        now: tuple | None = None
        for b in batches:
            b = b.select([*groups, "key", "at", "unit"])
            new = np.zeros(b.num_rows, bool)
            for g in groups:
                codes = b.column(g).dictionary_encode().indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for i, j in zip(starts, starts[1:], strict=False):
                if i == j:
                    continue
                group = tuple(b.column(g)[i].as_py() for g in groups)
                if held and group != now:
                    yield from block()
                    count, held[:] = count + 1, []
                if group != now:  # SPAN blocks from a multiple of it are of one group
                    count = -(-count // SPAN) * SPAN
                now = group
                while i < j:
                    room = most - sum(x.num_rows for x in held)
                    held.append(b.slice(i, min(room, j - i)))
                    i += held[-1].num_rows
                    if sum(x.num_rows for x in held) == most:
                        yield from block()
                        count, held[:] = count + 1, []
        if held:
            yield from block()

    order = [*groups, *(["at"] if in_time else ["cell", "angle"]), "key"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(cut, out)


class Join:
    """A join in blocks, up to its tiles; ``report`` counts the pairs of blocks."""

    def __init__(self, rows: DataFrame, days: float, by: list[str], threshold: float, block: int = BLOCK, sides: bool = False, *, in_time: bool = False):
        """rows: (*by, key, at, unit, side); sides: only rows of different sides meet; in_time: no angle is used, and a tile's first part stands before its second in (at, key)."""
        self.width, self.threshold, self.sides, self.block = int(days * DAY), threshold, sides, block
        bucket = F.floor(F.col("at") / F.lit(max(self.width, 1))).cast("long")
        rows = rows.where("unit IS NOT NULL AND at IS NOT NULL").dropna(subset=by) if by else rows.where("unit IS NOT NULL AND at IS NOT NULL")
        self.by, self.key_type = [*by], rows.schema["key"].dataType.simpleString()
        cut = materialise(_cut(rows.withColumn("bucket", bucket).withColumn("dim", F.size("unit")), by, block, in_time))
        self.rows, bounds = cut.where("n IS NULL").select("block", "key", "at", "unit", "side"), cut.where("n IS NOT NULL")
        keys = [*by, "dim"]
        a = bounds.select(*keys, F.explode(F.array("bucket", F.col("bucket") + 1)).alias("meet"), *[F.col(c).alias(f"a_{c}") for c in ("bucket", "side", "block", "n", "low", "high", "least", "most")])
        b = bounds.select(*keys, F.col("bucket").alias("meet"), *[F.col(c).alias(f"b_{c}") for c in ("bucket", "side", "block", "low", "high", "least", "most")])
        pairs = a.join(b, [*keys, "meet"]).where("a_bucket < b_bucket OR a_block < b_block OR a_block = b_block AND a_n > 1")
        if sides:
            pairs = pairs.where("a_side <> b_side")
        apart = F.greatest(F.col("b_low") - F.col("a_high"), F.col("a_low") - F.col("b_high")) > self.width
        gaps = F.zip_with(F.zip_with("a_least", "b_most", lambda x, y: x - y), F.zip_with("b_least", "a_most", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
        angle = math.acos(min(max(threshold, -1.0), 1.0)) + 1e-6
        self.pairs = materialise(pairs.select("a_block", "b_block", apart.alias("by_time"), F.exists(gaps, lambda g: g > F.lit(angle)).alias("by_angle")).withColumn("tile", F.monotonically_increasing_id()))

    def report(self) -> DataFrame:
        """One row: pairs of blocks, how many of them were ruled out by time and by angle, and the tiles left."""
        by_time, by_angle = F.col("by_time"), ~F.col("by_time") & F.col("by_angle")
        return self.pairs.agg(F.count("*").alias("block_pairs"), F.count_if(by_time).alias("ruled_out_by_time"), F.count_if(by_angle).alias("ruled_out_by_angle"), F.count_if(~by_time & ~F.col("by_angle")).alias("tiles"))

    def result(self, schema: str, reduce: Reducer, more: DataFrame | None = None, size: float = 0, look: Look | None = None) -> DataFrame:
        """What reduce makes of each tile. Left is the earlier row, or the one of side 0 if sides meet.

        more: (key, further columns) of the rows, those of about ``size`` bytes; rows without any meet
        nothing. They go to the tiles with their row, and look makes columns of pairs of them there.
        """
        width, threshold, sides = self.width, self.threshold, self.sides

        def tile(t: pa.Table) -> Iterator[pa.RecordBatch]:
            part, at, side, keys = t.column("part").to_numpy(), t.column("at").to_numpy(), t.column("side").to_numpy(), t.column("key").combine_chunks()
            units = _matrix(t.column("unit").combine_chunks())
            m, one = int((part == 0).sum()), _one(t)
            if not m:
                return
            step = max(AT_ONCE // max(m if one else len(part) - m, 1), 1)
            scores, also = look(t, 0 if one else m) if look else (None, None)
            for k in range(0, m, step):
                other, upto = k if one else m, min(k + step, m)
                s = scores(k, upto) if scores else units[k:upto] @ units[other:].T
                yield from piece(s, k, other, one, at, side, keys, also).to_batches()

        def piece(s: np.ndarray, k: int, other: int, one: bool, at: np.ndarray, side: np.ndarray, keys: pa.Array, also: Also | None) -> pa.Table:
            x, y = np.nonzero(s >= threshold)
            if one:
                x, y = x[x < y], y[x < y]
            sim = s[x, y]
            x, y = x + k, y + other
            if sides:
                swap = side[x] > side[y]
            else:  # within a tile rows stand by part, time and key
                later = at[x] > at[y]
                tie = at[x] == at[y]
                swap = later
                if not one and tie.any():
                    order = keys.to_numpy(zero_copy_only=False)
                    swap = later | (tie & (order[x] > order[y]))
            left, right = np.where(swap, y, x), np.where(swap, x, y)
            apart = np.abs(at[right] - at[left])
            near = (apart <= width) & (side[left] != side[right] if sides else True)
            left, right, sim, apart = left[near], right[near], sim[near], apart[near]
            out = reduce(keys.take(pa.array(left)), keys.take(pa.array(right)), sim, apart / float(DAY))
            for name, column in also(x[near], y[near], left, right).items() if also else ():
                out = out.append_column(name, column)
            return out

        return self.tiled(schema, tile, more, size)

    def tiled(self, schema: str, tile: Callable[[pa.Table], Iterator[pa.RecordBatch]], more: DataFrame | None = None, size: float = 0) -> DataFrame:
        """What ``tile`` makes of the rows of each tile, sorted by part, time and key; more and size as for result."""
        span = SPAN
        while span > 1 and span % 2 == 0 and span * self.block * size > RUN:  # a half, as groups start at multiples of SPAN
            span //= 2
        run = lambda c: F.floor(F.col(c) / F.lit(span))
        tiles = self.pairs.where("NOT by_time AND NOT by_angle").select(F.array("a_block", "b_block").alias("blocks"), F.least(run("a_block"), run("b_block")).alias("i"), F.greatest(run("a_block"), run("b_block")).alias("j"))
        both = materialise(tiles.select("i", "j", F.explode("blocks").alias("block")).distinct().withColumn("part", (run("block") > F.col("i")).cast("int")))
        few = both.count() <= 200_000  # else the rows are shuffled
        rows, further = (self.rows.join(more, "key"), [c for c in more.columns if c != "key"]) if more is not None else (self.rows, [])
        dealt = rows.join(F.broadcast(both) if few else both, "block").select("i", "j", "part", "key", "at", "unit", "side", *further)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            now = None
            for b in batches:
                i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
                starts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), b.num_rows]
                for x, y in zip(starts, starts[1:], strict=False):
                    if x == y:
                        continue
                    if held and now != (i[x], j[x]):
                        yield from tile(pa.Table.from_batches(held))
                        held = []
                    now = (i[x], j[x])
                    held.append(b.slice(x, y - x))
            if held:
                yield from tile(pa.Table.from_batches(held))

        return dealt.repartition("i", "j").sortWithinPartitions("i", "j", "part", "at", "key").mapInArrow(each, schema)


def prepared(news: DataFrame, by: list[str], key: str, side: int = 0) -> DataFrame:
    return news.select(*by, F.col(key).alias("key"), F.unix_micros("published_at").alias("at"), V.unit(F.col("embedding")).alias("unit"), F.lit(side).alias("side"))


def similar(news: DataFrame, threshold: float, days: float, by: list[str] | None = None, key: str = "row_pos", block: int = BLOCK) -> DataFrame:
    """(a, b, similarity, days_diff) of rows of equal ``by`` at most ``days`` apart and at least that similar; a is first in (published_at, key)."""
    by = ["topic"] if by is None else by
    join = Join(prepared(news, by, key), days, by, threshold, block)
    kind = join.key_type
    return join.result(f"a {kind}, b {kind}, similarity double, days_diff double", lambda a, b, s, d: pa.table({"a": a, "b": b, "similarity": s, "days_diff": d}))


def similar_to(new: DataFrame, old: DataFrame, threshold: float, days: float, by: list[str] | None = None, key: str = "news_id", block: int = BLOCK) -> DataFrame:
    """(new, old, similarity, days_diff) of rows of the two tables at most ``days`` apart, on either side."""
    by = ["topic"] if by is None else by
    join = Join(prepared(new, by, key).union(prepared(old, by, key, 1)), days, by, threshold, block, sides=True)
    kind = join.key_type
    return join.result(f"new {kind}, old {kind}, similarity double, days_diff double", lambda a, b, s, d: pa.table({"new": a, "old": b, "similarity": s, "days_diff": d}))


def best_earlier(news: DataFrame, days: float, k: int = 3, by: list[str] | None = None, key: str = "row_pos", block: int = BLOCK) -> DataFrame:
    """(key, n, tops, last): for each row that has earlier rows in the window their number, the k most similar ones and the latest.

    tops holds (similarity, days, key), most similar first, equal ones (to 12 digits) by time and key;
    last is (days, key). Pairs stay in their tile, which gives a row for each later row: blocks follow each other in time,
    so the earlier rows of a row are a stretch of the tile's first part, and only its k best are told apart.
    """
    by = ["topic"] if by is None else by
    join = Join(prepared(news, by, key), days, by, -2.0, block, in_time=True)
    kind, width = join.key_type, join.width

    def tile(t: pa.Table) -> Iterator[pa.RecordBatch]:
        at, keys, units = t.column("at").to_numpy(), t.column("key").combine_chunks(), _matrix(t.column("unit").combine_chunks())
        m, one = int((t.column("part").to_numpy() == 0).sum()), _one(t)
        step = max(AT_ONCE // max(m, 1), 1)
        for x in range(0 if one else m, len(at) if m else 0, step):  # later rows
            yield from best(at, keys, units, np.arange(x, min(x + step, len(at))), m, one)

    def best(at: np.ndarray, keys: pa.Array, units: np.ndarray, rows: np.ndarray, m: int, one: bool) -> Iterator[pa.RecordBatch]:
        upto = rows if one else np.full(len(rows), m)
        since = np.searchsorted(at[:m], at[rows] - width)
        low, high = int(since.min()), int(upto.max())
        s = units[rows] @ units[low:high].T
        own = s >= -2.0
        if one or (since > low).any():
            place = np.arange(low, high)
            own &= (place >= since[:, None]) & (place < upto[:, None])
        n = own.sum(1)
        if not n.any():
            return
        rows, s, own, n = (x[n > 0] for x in (rows, s, own, n))
        r, few = np.where(own, np.round(s, 12), -np.inf), min(k, s.shape[1])
        edge = np.partition(r, -few, axis=1)[:, -few, None]
        taken = (r >= edge) & own
        if (taken.sum(1) > few).any():  # of those equal to the last one taken, the first
            over = r > edge
            taken = over | (taken & (np.cumsum(taken & ~over, axis=1) <= few - over.sum(1, keepdims=True)))
        x, y = np.nonzero(taken)
        order = np.lexsort((y, -r[x, y], x))
        x, y = x[order], y[order]
        ends = np.append(0, np.cumsum(np.bincount(x, minlength=len(rows)))).astype(np.int32)
        last = low + own.shape[1] - 1 - own[:, ::-1].argmax(1)
        days_to = lambda later, earlier: pa.array((at[later] - at[earlier]) / float(DAY))
        tops = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s[x, y]), days_to(rows[x], y + low), keys.take(pa.array(y + low))], ["s", "d", "key"]))
        yield from pa.table({"key": keys.take(pa.array(rows)), "n": n.astype(np.int64), "tops": tops, "last": pa.StructArray.from_arrays([days_to(rows, last), keys.take(pa.array(last))], ["d", "key"])}).to_batches()

    parts = join.tiled(f"key {kind}, n long, tops array<struct<s: double, d: double, key: {kind}>>, last struct<d: double, key: {kind}>", tile)
    best_of = F.array_sort(F.transform(F.flatten(F.collect_list("tops")), lambda x: F.struct((-F.round(x["s"], 12)).alias("_s"), (-x["d"]).alias("_d"), x["key"].alias("key"), x["s"].alias("s"), x["d"].alias("d"))))
    tops = F.transform(F.slice(best_of, 1, k), lambda x: F.struct(x["s"].alias("s"), x["d"].alias("d"), x["key"].alias("key")))
    latest = F.max_by("last", F.struct(-F.col("last.d"), "last.key"))
    return parts.groupBy("key").agg(F.sum("n").alias("n"), tops.alias("tops"), latest.alias("last")).withColumnRenamed("key", key)
