"""A navigable small-world graph index for approximate nearest neighbours.

Rows are dealt by a hash to shards of about SHARD vectors. A shard's graph links each
vector to near ones that point in different directions (a neighbour is left out if it is
closer to one that is linked already) and back, and is one row of the index, which is
written as Parquet. A search walks every shard best first from a few entries, all queries
of a block at once: of the ``beam`` best vectors seen so far the best one not yet opened is
opened next, until none is left. The shards' neighbours are ranked by exact cosine.

Rows without a vector are not indexed; vectors of another length than a shard's first one are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import vector as V

SHARD, NEAR, LINKS, ENTRIES, BEAM, QUERIES = 20_000, 64, 16, 8, 48, 256


def linked(x: np.ndarray, near: int = NEAR, links: int = LINKS) -> np.ndarray:
    """Neighbours of each unit vector, an array of at most 2 * links columns, -1 where there are fewer."""
    n = len(x)
    k = min(near, n - 1)
    out = np.full((n, 2 * links), -1, np.int32)
    if k < 1:
        return out
    chosen = np.full((n, links), -1, np.int32)
    for at in range(0, n, 512):
        own = np.arange(at, min(at + 512, n))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
        score = np.take_along_axis(s, best, 1)
        count, keep = np.zeros(len(own), np.int64), np.zeros(best.shape, bool)
        between = np.einsum("ijd,ikd->ijk", x[best], x[best])
        for j in range(k):
            closer = (keep & (between[:, j] > score[:, j : j + 1])).any(1)
            keep[:, j] = ~closer & (count < links)
            count += keep[:, j]
        for j in range(k):  # free places go to the nearest left over
            more = ~keep[:, j] & (count < links)
            keep[:, j] |= more
            count += more
        row, col = np.nonzero(keep)
        chosen[own[row], np.cumsum(keep, 1)[row, col] - 1] = best[row, col]
    out[:, :links] = chosen
    source, target = np.repeat(np.arange(n), links)[chosen.ravel() >= 0], chosen.ravel()[chosen.ravel() >= 0]
    back = np.lexsort((-np.einsum("ij,ij->i", x[source], x[target]), target))  # links back, the nearest of them where there are too many
    first = np.searchsorted(target[back], np.arange(n))
    place = np.arange(len(back)) - first[target[back]]
    some = place < links
    out[target[back][some], links + place[some]] = source[back][some]
    return out


def walked(x: np.ndarray, links: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the best k for each query, -1 where there are fewer, and how many vectors were scored."""
    n, m = len(x), len(queries)
    beam = max(beam, k)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    entry = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64))
    place = np.full((m, beam), n)
    score = np.full((m, beam), -np.inf)
    opened = np.ones((m, beam), bool)
    place[:, : len(entry)], score[:, : len(entry)], opened[:, : len(entry)] = entry, queries @ x[entry].T, False
    seen[:, entry] = True
    scored = m * len(entry)
    live = np.arange(m)
    while len(live):
        rank = np.where(opened[live], -np.inf, score[live])
        at = rank.argmax(1)
        some = rank[np.arange(len(live)), at] > -np.inf
        live, at = live[some], at[some]
        if not len(live):
            break
        opened[live, at] = True
        near = links[place[live, at]].astype(np.int64)
        near[near < 0] = n
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        row, col = np.nonzero(new)
        s = np.full(near.shape, -np.inf)
        s[row, col] = np.einsum("ij,ij->i", x[near[row, col]], queries[live[row]])
        scored += len(row)
        all_place = np.concatenate([place[live], np.where(new, near, n)], 1)
        all_score = np.concatenate([score[live], s], 1)
        all_opened = np.concatenate([opened[live], ~new], 1)
        top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        place[live], score[live], opened[live] = (np.take_along_axis(a, top, 1) for a in (all_place, all_score, all_opened))
    order = np.lexsort((place, -score))[:, :k]
    place, score = np.take_along_axis(place, order, 1), np.take_along_axis(score, order, 1)
    return np.where(score > -np.inf, place, -1), score, scored


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def built(corpus: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, n, ids, vectors, links): one row for each shard. Write it, and search the written table."""
    rows = corpus.select(F.col("news_id").cast("string").alias("news_id"), V.doubles(F.col("embedding")).alias("embedding")).where("embedding IS NOT NULL")
    shards = max(-(-rows.count() // shard), 1)
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.string())), ("vectors", pa.binary()), ("links", pa.binary())])

    def build(t: pa.Table) -> pa.Table:
        ids, x = t.column("news_id").combine_chunks(), _units(t.column("embedding").combine_chunks())
        order = np.argsort(ids.to_numpy(zero_copy_only=False).astype(str), kind="stable")  # the same graph however rows arrive
        x = x[order]
        return pa.Table.from_pylist([{"shard": t.column("shard")[0].as_py(), "n": len(x), "ids": ids.take(pa.array(order)).to_pylist(), "vectors": x.tobytes(), "links": linked(x).tobytes()}], schema=schema)

    return rows.withColumn("shard", F.pmod(F.xxhash64("news_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, n int, ids array<string>, vectors binary, links binary")


def nearest(queries: DataFrame, index: DataFrame, k: int, beam: int = BEAM, exact: bool = False) -> DataFrame:
    """(query_id, news_id, score, rank, scored): the k best found for each query (query_id, query), and how many vectors it was compared with.

    exact: a walk's k-th score bounds what a shard can add, and all its vectors are held
    against that bound, so nothing that a walk has missed is lost; every vector is scored.
    """
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", V.doubles(F.col("query")).alias("query")).where("query IS NOT NULL")
    shards = index.agg(F.max("shard")).first()[0]
    none = lambda t: F.lit(None).cast(t)
    # A shard comes first in its task, then the queries, which meet every shard, in blocks.
    every = F.explode(F.sequence(F.lit(0), F.lit(shards))) if shards is not None else F.explode(F.array().cast("array<int>"))
    own = asked.select("query_id", "query", every.alias("shard")).select("shard", F.lit(1).alias("part"), "query_id", "query", none("array<string>").alias("ids"), none("binary").alias("vectors"), none("binary").alias("links"))
    heads = index.select("shard", F.lit(0).alias("part"), none(kind).alias("query_id"), none("array<double>").alias("query"), "ids", "vectors", "links")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = links = ids = now = None
        for batch in batches:
            part, shard = batch.column("part").to_numpy(), batch.column("shard").to_numpy()
            heads = np.flatnonzero(part == 0)
            cuts = sorted({0, *heads.tolist(), *(heads + 1).tolist(), *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows})
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z or part[a] == 1 and now != shard[a]:  # a shard without a row in the index
                    continue
                if part[a] == 0:
                    now = shard[a]
                    ids = batch.column("ids").slice(a, 1).flatten()
                    x = np.frombuffer(batch.column("vectors")[a].as_py()).reshape(len(ids), -1)
                    links = np.frombuffer(batch.column("links")[a].as_py(), np.int32).reshape(len(ids), -1)
                    continue
                for at in range(a, z, QUERIES):
                    rows = batch.slice(at, min(QUERIES, z - at))
                    own = _units(rows.column("query"))
                    place, score, scored = walked(x, links, own, k, beam)
                    row, col = np.nonzero(place >= 0)
                    found, best = place[row, col], score[row, col]
                    if exact:
                        s = own @ x.T
                        row, found = np.nonzero(s >= score[:, -1:] - 2e-9)  # ranks compare nine digits
                        best, scored = s[row, found], s.size
                    yield pa.RecordBatch.from_pydict({"query_id": rows.column("query_id").take(pa.array(row)), "news_id": ids.take(pa.array(found)), "score": pa.array(best), "scored": pa.array(np.full(len(row), scored / rows.num_rows))})

    met = heads.union(own).repartition("shard").sortWithinPartitions("shard", "part")
    found = met.mapInArrow(search, f"query_id {kind}, news_id string, score double, scored double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "scored").orderBy(F.round("score", 9).desc(), "news_id")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "news_id"))
    total = found.where("rank = 1").groupBy("query_id").agg(F.sum("scored").alias("scored"))
    return found.select("query_id", "news_id", "score").withColumn("rank", best).where(F.col("rank") <= k).join(total, "query_id")
