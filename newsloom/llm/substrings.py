"""Operator 5: substring deduplication by greedy factors relative to earlier documents.

Documents are dealt into chunks, and each chunk is a reference block whose index holds
every window of K words with the first document that has it. The indexes of all blocks
are shuffled by window, so each document is parsed against every block: what comes back
tells for each of its windows the earliest document of all that has it, if that is an
earlier one. A greedy factor starts at the first such window and goes on while windows
are found in the same document; it refers to that document. Windows across the border of
two factors are looked up like any other, so none that matches is missed. Factors of at
least K words are the duplicate spans.

What is shuffled: the texts once, by chunk (both passes read that same shuffle), 8 bytes
for each distinct window of a chunk, and as answer one bit for each and the runs of equal
sources. A window that every document has costs one entry for each chunk, not one for
each document. A row holds the windows of one chunk for one part; both grow with the
square root of the corpus between SIDE's bounds, so rows grow in proportion to it (up to
16 TB; from there rows get shorter).

Windows are compared by 64-bit hashes, mixed word by word and not linear in them: among N
distinct windows about N^2 / 2^65 pairs share a hash (5e-4 for 1.4e8, 3e4 of 1e12).

Defined results: a null, empty or short text keeps all its words; of rows with equal
doc_ids none is earlier than the other, so both keep what they share; rows without doc_id
come last; a very long text is parsed whole, in one chunk; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chunked, partitions, window_hashes, words_of

K = 13
LAST = 2**63 - 1  # stands for a missing doc_id
SIDE = (4 << 20, 128 << 20)  # least and most bytes of text in a chunk


def side(size: int) -> int:
    """Bytes of text in a chunk: a row of chunk and part for each 1024 bytes of all texts."""
    return min(max(int((size * 1024) ** 0.5), SIDE[0]), SIDE[1])


class Block:
    """The windows of a chunk: hashes, and of each distinct one its first document."""

    def __init__(self, doc_ids: list[int], texts: list[str | None], k: int, parts: int):
        doc_ids = [LAST if d is None else d for d in doc_ids]
        order = sorted(range(len(doc_ids)), key=lambda i: doc_ids[i])
        self.doc_ids = np.array([doc_ids[i] for i in order], np.int64)
        self.order = order
        w = Words([texts[i] for i in order])
        self.lengths = w.counts
        sizes = np.maximum(w.counts - k + 1, 0)
        self.ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(order)), w.counts)
        h = window_hashes(w.hash, k)
        h = h[word[: len(h)] == word[k - 1 :]] if len(h) else h
        # Equal doc_ids count as one document.
        self.doc = np.repeat(np.searchsorted(self.doc_ids, self.doc_ids, side="left"), sizes)
        by = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        group = np.empty(len(h), np.int64)
        group[by] = np.cumsum(new) - 1
        distinct = h[by][new]
        first = np.minimum.reduceat(self.doc[by], np.flatnonzero(new)) if len(h) else np.empty(0, np.int64)
        part = ((distinct >> U64(33)) % U64(parts)).astype(np.int64)
        # Entries in the order in which they are sent: by part, then by document.
        entry = np.lexsort((first, part))
        self.hash, self.first, self.part = distinct[entry], first[entry], part[entry]
        place = np.empty(len(entry), np.int64)
        place[entry] = np.arange(len(entry))
        self.entry = place[group]
        self.parts = parts

    def blobs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, doc_ids, entries of each, hashes)."""
        cuts = np.searchsorted(self.part, np.arange(self.parts + 1))
        for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if z > a:
                docs, n = np.unique(self.first[a:z], return_counts=True)
                yield p, self.doc_ids[docs], n.astype(np.uint32), self.hash[a:z]

    def hits(self, answers: dict[int, tuple[bytes, bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each document, in order, which of its windows an earlier document has, and the earliest that has it."""
        cuts = np.searchsorted(self.part, np.arange(self.parts + 1))
        found, source = np.zeros(len(self.hash), bool), self.doc_ids[self.first] if len(self.first) else np.empty(0, np.int64)
        for p, (bits, docs, n) in answers.items():
            own = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[p + 1] - cuts[p]).astype(bool)
            found[cuts[p] : cuts[p + 1]] = own
            source[cuts[p] + np.flatnonzero(own)] = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(n, np.uint32))
        hit = found[self.entry] | (self.doc > self.first[self.entry])
        source, starts = source[self.entry], np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        for a, z in zip(starts.tolist(), self.ends.tolist(), strict=False):
            yield hit[a:z], source[a:z]


def factors(hit: np.ndarray, source: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start, length in words, source) of the greedy factors: runs of windows that were found in one document."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (source[at[1:]] != source[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return list(zip(at[first].tolist(), (n + k - 1).tolist(), source[at[first]].tolist(), strict=True))


def covered(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, length, _ in spans:
        out[a : a + length] = True
    return out


def deduplicated(docs: DataFrame, k: int = K, as_is: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept, *more) with the kept words joined by one space.

    as_is: a text that loses no word is kept unchanged. more: columns of docs to carry along.
    """
    chunks, _, size = chunked(docs, side, more)
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*more).schema)
    parts = max(16, size // side(size))

    def index(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        rows = [(p, chunk, d.tobytes(), n.tobytes(), h.tobytes()) for p, d, n, h in Block(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), k, parts).blobs()]
        kinds = [("part", pa.int32()), ("chunk", pa.int32()), ("docs", pa.binary()), ("n", pa.binary()), ("hashes", pa.binary())]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[x for x, _ in kinds])

    def look_up(t: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        hashes = read("hashes", np.uint64)
        doc = np.concatenate([np.repeat(d, n) for d, n in zip(read("docs", np.int64), read("n", np.uint32), strict=True)])
        h = np.concatenate(hashes)
        by = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        first = np.minimum.reduceat(doc[by], np.flatnonzero(new))
        least = np.empty(len(h), np.int64)
        least[by] = first[np.cumsum(new) - 1]
        rows = []
        cut = np.cumsum([len(x) for x in hashes])[:-1]
        for own, low in zip(np.split(doc, cut), np.split(least, cut), strict=True):
            found = own > low
            low = low[found]
            edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.empty(0, np.int64)
            rows.append((np.packbits(found).tobytes(), low[edge].tobytes(), np.diff(np.append(edge, len(low))).astype(np.uint32).tobytes()))
        return pa.table({"chunk": t.column("chunk"), "part": t.column("part"), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("bits", "docs", "n"))}})

    def parse(t: pa.Table, answers: pa.Table) -> pa.Table:
        texts = t.column("text").to_pylist()
        own = Block(t.column("doc_id").to_pylist(), texts, k, parts)
        known = dict(zip(answers.column("part").to_pylist(), zip(*(answers.column(c).to_pylist() for c in ("bits", "docs", "n")), strict=True), strict=True))
        rows = []
        for i, doc, n, hit in zip(own.order, own.doc_ids.tolist(), own.lengths.tolist(), own.hits(known), strict=True):
            spans = factors(*hit, k)
            if spans or not as_is:
                w = words_of(texts[i])
                kept = [x for x, gone in zip(w, covered(spans, n).tolist(), strict=True) if not gone] if spans else w
                left, text = len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")
            else:
                left, text = n, texts[i] or ""
            rows.append((None if doc == LAST else doc, n, n - left, [{"start": a, "length": m, "source": x} for a, m, x in spans], text))
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64())]))
        out = pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), span, pa.string()))], names=["doc_id", "n_words", "n_removed", "spans", "kept"])
        order = pa.array(own.order, pa.int64())
        for c in more:
            out = out.append_column(c, t.column(c).take(order))
        return out

    sent = chunks.groupBy("chunk").applyInArrow(index, "part int, chunk int, docs binary, n binary, hashes binary")
    answers = sent.repartition(partitions(docs.sparkSession), "part").groupBy("part").applyInArrow(look_up, "chunk int, part int, bits binary, docs binary, n binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(parse, "doc_id long, n_words long, n_removed long, spans array<struct<start: int, length: int, source: long>>, kept string" + carried)


def digest(rows: DataFrame) -> DataFrame:
    """The digest columns of deduplicated()."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: Every window in DuckDB, for unique doc_ids.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + {K - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {K})) AS p FROM hit),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_ USING (doc_id)"""


def brute_force(rows: list[tuple[int, str | None]], k: int = K) -> dict[int, tuple[int, int, str]]:
    """The same by a plain dictionary, for tests."""
    first: dict[tuple, int] = {}
    texts = {d: words_of(t) for d, t in rows}
    for d, w in sorted(texts.items()):
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    out = {}
    for d, w in texts.items():
        gone = {p for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for p in range(i, i + k)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
