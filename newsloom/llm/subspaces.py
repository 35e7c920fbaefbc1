"""Operator 4: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within a squared distance of t = 2 - 2c. After a fixed
random rotation, which spreads a vector evenly, coordinates are split into BLOCKS blocks.
Some block must hold at most its proportional share of t (pigeonhole), so a range join of
each block under that budget finds every pair; the union is verified with the cosine of
the vectors as given, in double precision.

A block's range join is dealt by grid cells: the signs of its first coordinates, as many
as the largest label needs for cells of about CELL vectors. A vector is at home in its
cell and also visits each cell that its ball of the budget's radius reaches. Within a
task, distances in the block are matrix products of bounded size; a cell is as large as
its vectors' memory allows, as each further sign sends about 1.43 times the rows. A pair
is counted once: in the home cell of its smaller id, in the first block whose budget it
meets. Cells with more rows than WIDE are split by a hash, and each part of the homes
meets each part of the rows, so no task holds a whole cell. Vectors that are equal with
equal labels are one class before all that.

Cells hold the rotated vectors in single precision. They tell the cosine to better than
CLOSE; only pairs within CLOSE of the wanted one are sent on and decided by the vectors as
given, in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
those without a label or vec_id, link with nothing; vectors of different lengths never link;
labels are compared by their text, whatever their type; rows that share a vec_id are
vectors of their own; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_runs, materialise, min_labels

COSINE, BLOCKS, CELL, WIDE, SEED, CLOSE = 0.98, 8, 65_536, 131_072, 20, 2e-6
AT_ONCE = 1 << 22  # distances that a task holds at once


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts(dim: int) -> list[tuple[int, int]]:
    """The blocks of coordinates."""
    edge = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int).tolist()
    return list(zip(edge, edge[1:], strict=False))


def budget(dim: int, a: int, z: int, cosine: float) -> float:
    """A block's share of the squared distance, with room for single-precision rounding."""
    return (2 - 2 * cosine) * (z - a) / dim * (1 + 1e-3) + 1e-6


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    flat, offsets = column.flatten(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if flat.null_count == 0 else np.array([np.nan if x is None else x for x in flat.to_pylist()], np.float64)
    for i, a, z in zip(range(len(column)), offsets.tolist(), offsets[1:].tolist(), strict=False):
        v = values[int(a) : int(z)]
        yield v if column[i].is_valid and len(v) and np.isfinite(v).all() and v.any() else None


def classes(rows: DataFrame) -> DataFrame:
    """(vec_id, label, raw): the vector as bytes; null for one that links with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = pa.compute.and_(b.column("label").is_valid(), b.column("vec_id").is_valid()).to_pylist()
            raw = [v.tobytes() if v is not None and ok else None for v, ok in zip(_vectors(b.column("embedding")), known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    own = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return own.mapInArrow(read, "vec_id long, label string, raw binary")


def signs(most: int) -> int:
    """How many signs deal a label of that many vectors to cells of CELL or fewer at home."""
    return max(0, (-(-most // CELL) - 1).bit_length())


def dealt(reps: DataFrame, count: int, cosine: float) -> DataFrame:
    """A row for each vector, block and cell that it lives in or visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for b in batches:
            size = pa.compute.divide(pa.compute.binary_length(b.column("raw")), 8).to_numpy()
            for d in np.unique(size).tolist():
                own = b.take(pa.array(np.flatnonzero(size == d)))
                if d not in turn:
                    turn[d] = rotation(d)
                v = np.frombuffer(b"".join(own.column("raw").to_pylist()), np.float64).reshape(-1, d)
                y = (v / np.abs(v).max(1, keepdims=True)) @ turn[d]
                y = (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)
                turned = pa.array([r.tobytes() for r in y], pa.binary())
                for k, (a, z) in enumerate(cuts(d)):
                    part = y[:, a : min(z, a + count)].astype(np.float64)
                    home = ((part >= 0) << np.arange(part.shape[1])).sum(1)
                    near = np.abs(part) <= budget(d, a, z, cosine) ** 0.5
                    row, cell = np.arange(len(y)), home
                    for i in range(part.shape[1]):
                        also = near[row, i]
                        row, cell = np.concatenate([row, row[also]]), np.concatenate([cell, cell[also] ^ (1 << i)])
                    at, of = pa.array(row), np.full(len(row), d, np.int32)
                    yield pa.RecordBatch.from_pydict({"label": own.column("label").take(at), "dim": of, "block": np.full(len(row), k, np.int32), "cell": cell.astype(np.int64), "home": cell == home[row], "rep": own.column("rep").take(at), "copies": own.column("copies").take(at), "turned": turned.take(at)})

    return reps.select("label", "rep", "copies", "raw").mapInArrow(deal, "label string, dim int, block int, cell long, home boolean, rep long, copies long, turned binary")


def _reached(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each reaches by the edges (p, q)."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[p], label[q]), label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, hub, n, close): links of each vector in a cell, counted by copies, and one link of its tree; or a pair (rep, close) that is too close to tell."""
    schema = pa.schema([(c, pa.int64()) for c in ("rep", "hub", "n", "close")])

    def join(t: pa.Table) -> Iterator[pa.RecordBatch]:
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        rep, copies, home, probe = (t.column(c).to_numpy() for c in ("rep", "copies", "home", "probe"))
        probe = np.flatnonzero(probe)
        y = np.frombuffer(b"".join(t.column("turned").to_pylist()), np.float32).reshape(-1, dim)
        own = cuts(dim)
        a, z = own[block]
        part, limit = y[:, a:z], budget(dim, a, z, cosine)
        square, one = (part * part).sum(1, keepdims=True), np.ones((len(rep), 1), np.float32)
        left, right = np.concatenate([-2 * part, square, one], 1), np.concatenate([part, one, square], 1)[probe].T  # their product is the squared distance
        n, at = np.zeros(len(rep), np.int64), np.flatnonzero(home)
        pairs, close = [], []
        step = max(AT_ONCE // max(len(probe), 1), 1)
        for h in (at[k : k + step] for k in range(0, len(at), step)):
            i, j = np.nonzero(left[h] @ right <= limit + 1e-5)
            i, j = h[i], probe[j]
            i, j = i[rep[i] < rep[j]], j[rep[i] < rep[j]]
            for s in range(0, len(i), 1 << 16):
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                first = np.full(len(p), -1)
                for k in range(block, -1, -1):
                    b0, b1 = own[k]
                    met = ((y[p, b0:b1] - y[q, b0:b1]) ** 2).sum(1) <= budget(dim, b0, b1, cosine)
                    first[met] = k
                p, q = p[first == block], q[first == block]
                c = (y[p].astype(np.float64) * y[q]).sum(1)
                unsure = np.abs(c - cosine) <= CLOSE
                close.append((rep[p[unsure]], rep[q[unsure]]))
                p, q = p[c > cosine + CLOSE], q[c > cosine + CLOSE]
                np.add.at(n, p, copies[q])
                np.add.at(n, q, copies[p])
                pairs.append((p, q))
        if close and len(ends := np.concatenate([x for x, _ in close])):
            none = pa.nulls(len(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ends), none, none, pa.array(np.concatenate([x for _, x in close]))], schema=schema)
        if n.any():
            p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(rep, kind="stable")
            place = np.empty(len(rep), np.int64)
            place[order] = np.arange(len(rep))
            label, some = _reached(len(rep), place[p], place[q]), n > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[order][label][place[some]]), pa.array(n[some]), pa.nulls(int(some.sum()), pa.int64())], schema=schema)

    return in_runs(rows, ["label", "dim", "block", "cell", "i", "j"], ["rep", "home"], join, "rep long, hub long, n long, close long", least=2)


def exact(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    """(rep, hub, n) of the pairs (rep, close) whose vectors, as given, have the wanted cosine; a row for each end."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, q, v, w, m, n in zip(*(b.column(c).to_pylist() for c in ("rep", "close", "v", "w", "m", "n")), strict=True):
                v, w = (x / np.abs(x).max() for x in (np.frombuffer(v, np.float64), np.frombuffer(w, np.float64)))
                if (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())) >= cosine:
                    yield pa.RecordBatch.from_pydict({"rep": pa.array([p, q]), "hub": pa.array([p, p]), "n": pa.array([n, m])})

    a = reps.select("rep", F.col("raw").alias("v"), F.col("copies").alias("m"))
    b = reps.select(F.col("rep").alias("close"), F.col("raw").alias("w"), F.col("copies").alias("n"))
    return pairs.join(a, "rep").join(b, "close").mapInArrow(decide, "rep long, hub long, n long")


def linked(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows (vec_id, embedding, label)."""
    read = materialise(classes(rows))
    # Numbers of classes stand in the order of their smallest vec_ids, so the smallest number reached leads to the smallest vec_id.
    reps = read.where("raw IS NOT NULL").groupBy("label", "raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = materialise(reps.orderBy("low", "label", "raw").withColumn("rep", F.monotonically_increasing_id()))
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    cells = dealt(reps, signs(most), cosine)
    key = ["label", "dim", "block", "cell"]
    wide = cells.groupBy(*key).count().where(F.col("count") > WIDE).select(*key, F.ceil(F.col("count") / F.lit(WIDE)).cast("int").alias("parts"))
    split = cells.join(F.broadcast(wide), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    # Of a wide cell each part of its homes meets each part of all its rows.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    role = lambda i, j, home, probe: F.struct(i.alias("i"), j.alias("j"), home.alias("as_home"), probe.alias("as_probe"))
    yes, no = F.lit(True), F.lit(False)
    homes = F.when(F.col("home"), F.transform(every, lambda x: role(F.col("own"), x, yes, no))).otherwise(F.filter(F.transform(every, lambda x: role(F.col("own"), x, yes, no)), lambda x: no))
    roles = F.when(F.col("parts") == 1, F.array(role(F.lit(0), F.lit(0), F.col("home"), yes))).otherwise(F.concat(homes, F.transform(every, lambda x: role(x, F.col("own"), no, yes))))
    split = split.withColumn("role", F.explode(roles))
    told = materialise(verified(split.select(*key, "role.i", "role.j", F.col("role.as_home").alias("home"), F.col("role.as_probe").alias("probe"), "rep", "copies", "turned"), cosine))
    found = materialise(told.where("close IS NULL").select("rep", "hub", "n").union(exact(told.where("close IS NOT NULL").select("rep", "close"), reps, cosine)))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reach = min_labels(found.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("id").alias("rep"), "component")
    first = reps.select(F.col("rep").alias("component"), F.col("low").alias("first"))
    ends = reps.join(n, "rep", "left").join(reach.join(first, "component"), "rep", "left")
    ends = ends.select("label", "raw", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("first", "low").alias("first"))
    component = F.coalesce("first", "vec_id")
    return read.join(ends, ["label", "raw"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


#: All pairs in DuckDB; for small tables.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT near.b, reach.low FROM reach JOIN near ON near.a = reach.id),
n AS (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY 1),
c AS (SELECT id AS vec_id, min(low) AS component_id FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
