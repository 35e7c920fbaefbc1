"""Operator 12: ranked lexical search with variable-block-max WAND.

``postings`` reads every text once and keeps, for the terms that the items ask for, how
often each occurs; the written rows give N, L and each term's df. ``search`` then reads
those rows in shards of SHARD documents. In a shard each term's posting list is cut into
blocks by a dynamic programme: of all ways to cut it into blocks of at most WIDEST
postings it takes the one with the least sum of bound errors (a block's highest score
minus each of its scores) and of a price for each block.

A query's lists cut the shard into intervals in which every list stays in one block. As
in WAND an interval is passed over if the highest scores of its blocks, summed over the
lists, can't reach the tenth best score so far. Intervals are visited by falling bound, so
that score rises early, and only blocks that meet an interval still open are read. The best
ten of each item go on from shard to shard in a task; the tasks' tens are ranked by Spark.

Items are taken in blocks of about ITEM_BYTES bytes of text; a block's terms are the only
thing that is broadcast, and each block reads all documents. No task holds more than a shard.

Defined results: a null or empty text has no term and counts for nothing; items without
a term that a document has get no row; repeated rows are documents, or items, of their
own; among equal scores rows without doc_id come last; very long texts are read whole;
extra columns are ignored; an empty table of either kind gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from newsloom.operators.components import cumulative

from .common import materialise, slices, written

SHARD, WIDEST, PRICE, TOP, ITEM_BYTES = 16_384, 64, 4.0, 10, 4 << 20
#: Bytes of terms stay, A-Z lower-cased; all others become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has one of terms, written; and rows of (docs, total): documents with a term of any kind, and their terms."""
    known = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("docs", pa.int64()), ("total", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch.column("text")):
                rows, n, ends, t, f, docs, total = [], [], [0], [], [], 0, 0
                for i, text in enumerate(texts, at):
                    words = terms_of(text)
                    docs, total = docs + bool(words), total + len(words)
                    count = Counter(map(get, words))
                    count.pop(None, 0)
                    if count:
                        rows.append(i)
                        n.append(len(words))
                        t.extend(count)
                        f.extend(count.values())
                        ends.append(len(t))
                own = [ids.take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *[pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (t, f)]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(rows), pa.int64())] * 2], schema=schema)
                yield pa.RecordBatch.from_pylist([{"docs": docs, "total": total}], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<int>, docs long, total long"))


def cut(scores: np.ndarray, sizes: np.ndarray, price: np.ndarray, widest: int = WIDEST) -> np.ndarray:
    """Where blocks begin in each row of scores (row r has sizes[r] of them), as a boolean array.

    Minimises, for each row, the sum over blocks of price plus (highest score - score) of
    each posting. The best cut of the first i postings ends with a block of at most
    ``widest``; all such blocks are tried, for all rows at once.
    """
    rows, n = scores.shape
    before = np.zeros((rows, n + 1))
    np.cumsum(scores, axis=1, out=before[:, 1:])
    best, back = np.zeros((rows, n + 1)), np.zeros((rows, n + 1), np.int64)
    start = np.zeros(widest, np.int64)
    high, base = np.zeros((rows, widest)), np.zeros((rows, widest))
    for i in range(1, n + 1):
        at, k = (i - 1) % widest, min(i, widest)
        start[at] = i - 1
        high[:, at] = 0
        base[:, at] = best[:, i - 1] + before[:, i - 1] + price
        np.maximum(high[:, :k], scores[:, i - 1 : i], out=high[:, :k])
        value = base[:, :k] + high[:, :k] * (i - start[:k])
        j = value.argmin(1)
        best[:, i] = value[np.arange(rows), j] - before[:, i]
        back[:, i] = i - start[j]
    begins, r, at = np.zeros((rows, n), bool), np.arange(rows), sizes.copy()
    while len(r):
        at = at - back[r, at]
        begins[r, at] = True
        r, at = r[at > 0], at[at > 0]
    return begins


class Shard:
    """Posting lists of one shard with their blocks; document numbers are places in the shard."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray, documents: int, total: int):
        self.size = len(n)
        order = np.argsort(terms, kind="stable")
        self.doc, self.term = np.repeat(np.arange(len(n)), counts)[order], terms[order]
        tf, m = tfs[order].astype(np.int64), 25 + (75 * n * documents) // total
        self.score = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        first = np.flatnonzero(np.diff(self.term, prepend=-1))
        self.lists = dict(zip(self.term[first].tolist(), range(len(first)), strict=True))
        self.list_at = np.append(first, len(self.term))
        begins = self._blocks(first, np.diff(self.list_at))
        self.at = np.append(np.flatnonzero(begins), len(self.term))  # of blocks
        self.block_of = np.searchsorted(self.at, self.list_at)  # a list's first block
        self.high = np.maximum.reduceat(self.score, self.at[:-1]) if len(self.term) else np.empty(0, np.int64)
        self.low_doc, self.end_doc = self.doc[self.at[:-1]], self.doc[self.at[1:] - 1] + 1
        self.read = 0  # postings that searches have read

    def _blocks(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(self.term), bool)
        kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for k in np.unique(kind).tolist():  # lists of about one length are cut together
            own = np.flatnonzero(kind == k)
            for part in np.array_split(own, -(-len(own) << k >> 20) or 1):
                inside = np.arange(1 << k) < sizes[part, None]
                at = np.where(inside, first[part, None] + np.arange(1 << k), 0)
                scores = np.where(inside, self.score[at], 0).astype(float)
                found = cut(scores, sizes[part], PRICE * scores.max(1), min(WIDEST, 1 << k))
                begins[at[found & inside]] = True
        return begins

    def search(self, query: dict[int, int], worst: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents, in which all are that score ``worst`` or more and above 0 and are among the best TOP."""
        own = [(self.lists[t], q) for t, q in query.items() if t in self.lists]
        if not own:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        blocks = np.concatenate([np.arange(self.block_of[i], self.block_of[i + 1]) for i, _ in own])
        times = np.repeat([q for _, q in own], [self.block_of[i + 1] - self.block_of[i] for i, _ in own])
        low, end, high = self.low_doc[blocks], self.end_doc[blocks], self.high[blocks] * times
        edges, where = np.unique(np.concatenate([low, end]), return_inverse=True)
        step = np.zeros(len(edges), np.int64)
        np.add.at(step, where, np.concatenate([high, -high]))
        bound, width = np.cumsum(step)[:-1], np.diff(edges)  # of the intervals between edges
        order, at, batch = np.argsort(-bound, kind="stable"), 0, 128
        worst, places, scores = max(worst, 1), np.empty(0, np.int64), np.empty(0, np.int64)
        while at < len(order) and bound[order[at]] >= worst:
            stop = at + max(1, int(np.searchsorted(np.cumsum(width[order[at:]]), batch)))
            chosen = order[at:stop]
            chosen = chosen[bound[chosen] >= worst]
            open_ = np.zeros(len(edges), bool)
            open_[chosen] = True
            inside = np.zeros(self.size + 1, np.int64)
            np.add.at(inside, edges[chosen], 1)
            np.add.at(inside, edges[chosen + 1], -1)
            inside = np.cumsum(inside[:-1]) > 0
            count = np.concatenate([[0], np.cumsum(open_)])
            a, b = where[: len(blocks)], where[len(blocks) :]
            hit = np.flatnonzero(count[b] > count[a])  # blocks that meet a chosen interval
            size = self.at[blocks[hit] + 1] - self.at[blocks[hit]]
            p = np.repeat(self.at[blocks[hit]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            self.read += len(p)
            d = self.doc[p]
            take = inside[d]
            sums = np.zeros(self.size, np.int64)
            np.add.at(sums, d[take], (self.score[p] * np.repeat(times[hit], size))[take])
            found = np.flatnonzero(sums >= worst)
            places, scores = np.concatenate([places, found]), np.concatenate([scores, sums[found]])
            if len(scores) >= TOP:
                worst = max(worst, int(np.partition(scores, -TOP)[-TOP]))
            at, batch = stop, 2 * batch
        keep = scores >= worst
        return places[keep], scores[keep]


def _best(indexed: DataFrame, items: list[Row], queries: list[dict[int, int]], weight: np.ndarray, documents: int, total: int) -> DataFrame:
    """(no, item_id, doc_id, score): each task's TOP for each item."""
    plan = indexed.sparkSession.sparkContext.broadcast((queries, weight))
    ids, (documents, total) = [r.item_id for r in items], (documents, total)
    out_schema = pa.schema([("no", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = plan.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]  # (-score, no doc_id, doc_id)

        def searched(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: t.column(c).combine_chunks()
            shard = Shard(col("n").to_numpy(), col("terms").value_lengths().to_numpy(), col("terms").flatten().to_numpy(), col("tfs").flatten().to_numpy(), weight, documents, total)
            gone, doc = col("doc_id").is_null().to_numpy(zero_copy_only=False), col("doc_id").fill_null(0).to_numpy()
            for k, query in enumerate(queries):
                places, scores = shard.search(query, -best[k][-1][0] if len(best[k]) == TOP else 1)
                if len(places):
                    best[k] = sorted([*best[k], *zip((-scores).tolist(), gone[places].tolist(), doc[places].tolist(), strict=True)])[:TOP]

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = SHARD - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == SHARD:
                    searched(held)
                    held = []
        if held:
            searched(held)
        rows = [(k, ids[k], None if gone else doc, -score) for k, own in enumerate(best) for score, gone, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=out_schema)

    return indexed.where("n IS NOT NULL").select("doc_id", "n", "terms", "tfs").mapInArrow(run, "no long, item_id long, doc_id long, score long")


def item_blocks(items: DataFrame, most: int) -> Iterator[list[Row]]:
    """The rows (item_id, text) in lists of about ``most`` bytes of text, each row counted with 200 more."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 200)
    total = own.agg(F.sum("size")).first()[0] or 0
    if total <= most:
        yield own.collect()
        return
    dealt = materialise(cumulative(own, {"upto": "size"}, F.col("item_id"), F.col("text")).withColumn("block", F.floor(F.col("upto") / most)))
    for b in range(total // most + 1):
        yield dealt.where(F.col("block") == b).collect()


def ranked_documents(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each item, best first."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, item_bytes):
        asked = [Counter(terms_of(r.text)) for r in block]
        terms = {t: i for i, t in enumerate(dict.fromkeys(t for q in asked for t in q))}
        if not terms:
            continue
        indexed = postings(docs, terms)
        documents, total = indexed.agg(F.sum("docs"), F.sum("total")).first()
        if not total:
            continue
        df = np.zeros(len(terms), np.int64)
        for t, n in indexed.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # no more rows than terms of a block of items
            df[t] = n
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        best = _best(indexed, block, [{terms[t]: q for t, q in own.items()} for own in asked], weight, documents, total)
        own = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        part = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
r AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY 1, 2),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
