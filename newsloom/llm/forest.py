"""Operator 3: n-gram Jaccard join by a MinHash LSH forest.

Shingles are runs of K words (a shorter text is one shingle). Texts with equal shingle
sets are one class, found by a digest of the set; only one member of each goes on. Each
of TREES trees labels a class with DEPTH MinHashes; labels that share the shortest prefix
come to one task sorted, which is a subtree of the tree's prefix trie. There the longest
matched prefixes are looked at first and are then shortened value by value. A pair that
meets in a prefix of d values is compared where its sizes allow the wanted similarity and
d is not below the length x that its classes need: the longest with
1 - (1 - s^x)^TREES >= RECALL, s being the least similarity, from the wanted one on, that
sets of such sizes can have (so x is 4 or more, with a recall of 0.99997 at 0.8; sets of
six need no more than 5). Pairs that are joined already aren't compared again: what agrees
in half of 64 signature bytes (a pair at 0.8 does so but for one in 10^7) is linked to a
spanning forest, not to all pairs.

Those links only decide which texts meet: the components of the candidate graph are
split into blocks by a hash, each pair of blocks is one task, and there the exact
similarity of all its pairs is counted from the shingles, without emitting a row for
each pair. Subtrees of more than WIDE classes are read in pieces and linked without the
signature test, so nothing is capped and no task holds more than a piece. A component of
N classes sends each of its texts N / BLOCK times, as all its pairs have to meet.

Defined results: null and empty texts link with nothing; rows without doc_id are left
out; repeated rows are copies of each other, and rows that share a doc_id but not the text
are documents of their own; a very long text is one set; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, in_runs, joined, materialise, min_labels, mixed, slices, window_hashes, words_of

K, SIMILARITY, TREES, DEPTH, RECALL = 5, 0.8, 20, 6, 0.9999
SKETCH, WIDE, BLOCK, BLOCK_SHINGLES = 64, 2048, 1500, 4_000_000

_factors = mixed(np.arange(1, TREES * DEPTH + 1, dtype=U64)) | U64(1)


def depth(similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten prefixes until the recall at the wanted similarity is reached."""
    x = deepest
    while x > 1 and 1 - (1 - similarity**x) ** trees < recall:
        x -= 1
    return x


def least_similarity(n: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The least similarity, from the wanted one on, that a set of n shingles can have with another set; above 1 if none."""
    out = np.full(len(n), 2.0)
    n = n.astype(np.float64)
    for more in range(64):  # the other set has so many of its own; with more, the bound is close to the wanted one
        common = np.ceil(similarity * (n + more) - 1e-9)  # of n, as few as allowed
        s = common / (n + more)
        ok = (common <= n) & (common > 0) & ((more > 0) | (common < n) | (n == 0))
        out = np.where(ok & (s < out), s, out)
    return np.where(n > 64, similarity, out)


def shingle_sets(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    all_, out, at = window_hashes(w.hash, k), [], 0
    for n in w.counts.tolist():
        if n >= k:
            out.append(np.unique(all_[at : at + n - k + 1]))
        elif n:
            out.append(mixed(window_hashes(w.hash[at : at + n], n) + U64(n)))
        else:
            out.append(np.empty(0, U64))
        at += n
    return out


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, mark, key, n, signature): a hash of the text, the set's digest and size, and its MinHashes, 4 bytes each."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("signature", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column("text"), 1 << 19):
                sets = shingle_sets(texts, k)
                full = [s for s in sets if len(s)]
                low = np.empty((len(full), len(_factors)), np.uint32)
                if full:
                    flat, starts = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
                    for i, f in enumerate(_factors):
                        low[:, i] = np.minimum.reduceat(flat * f, starts) >> U64(32)
                rows = iter(low)
                sig = [next(rows).tobytes() if len(s) else None for s in sets]
                key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(texts)) for c in ("doc_id", "mark")), pa.array(key, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").where("doc_id IS NOT NULL")
    return own.mapInArrow(sign, "doc_id long, mark long, key binary, n long, signature binary")


def climbed(label: np.ndarray, n: np.ndarray, need: np.ndarray, sketch: np.ndarray, shortest: int, similarity: float) -> np.ndarray:
    """For each row of a subtree, sorted by label, the first row that it is joined with.

    Prefixes are walked from the longest to the shortest; a node whose rows are joined
    already is passed by.
    """
    hub = np.arange(len(label))
    same = np.cumprod(label[1:] == label[:-1], axis=1).sum(1)  # values that neighbours share
    for d in range(label.shape[1], shortest - 1, -1):
        cut = np.flatnonzero(same < d) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(label)], strict=True):
            if z - a < 2 or (hub[a:z] == hub[a]).all():
                continue
            own = np.arange(a, z)
            agree = (sketch[own, None] == sketch[None, own]).sum(2) if z - a <= 256 else np.stack([(sketch[own] == row).sum(1) for row in sketch[own]])
            small, large = np.minimum(n[own, None], n[None, own]), np.maximum(n[own, None], n[None, own])
            ok = (agree >= sketch.shape[1] // 2) & (small >= similarity * large - 1e-9) & (np.maximum(need[own, None], need[None, own]) <= d)
            ok |= hub[own, None] == hub[None, own]
            first = own[joined(ok)]
            for h in np.unique(hub[own]).tolist():  # rows outside this node keep their company
                hub[hub == h] = min(h, int(hub[first[hub[own] == h]].min()))
    return hub


def candidates(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): a spanning forest of the classes (rep, n, signature) that meet in the forest."""
    schema = pa.schema([("tree", pa.int32()), ("prefix", pa.int64()), ("label", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    x = depth(similarity)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(b.num_rows, TREES, DEPTH)
            sketch = pa.array([r.tobytes() for r in np.ascontiguousarray(sig.reshape(b.num_rows, -1)[:, :SKETCH].astype(np.uint8))], pa.binary())
            for t in range(TREES):
                prefix = np.zeros(b.num_rows, U64)
                for d in range(x):
                    prefix = mixed(prefix * U64(3) + sig[:, t, d])
                label = pa.array([r.tobytes() for r in sig[:, t].astype(">u4")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(prefix.view(np.int64)), label, b.column("rep"), b.column("n"), sketch], schema=schema)

    def climb(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """One subtree below a shortest prefix."""
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        if t.schema.metadata and b"split" in t.schema.metadata:
            hub = np.full(len(rep), rep.min())
        else:
            read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(rep), -1)
            least = least_similarity(n, similarity)
            deep = {s: depth(s) if s <= 1 else DEPTH + 1 for s in set(least.tolist())}
            hub = rep[climbed(read("label", ">u4"), n, np.array([deep[s] for s in least.tolist()]), read("sketch", np.uint8), x, similarity)]
        links = rep != hub
        if links.any():
            yield pa.RecordBatch.from_pydict({"a": pa.array(rep[links]), "b": pa.array(hub[links])})

    planted = classes.select("rep", "n", "signature").mapInArrow(plant, "tree int, prefix long, label binary, rep long, n long, sketch binary")
    return in_runs(planted, ["tree", "prefix"], ["label", "rep"], climb, "a long, b long", least=2, most=WIDE).distinct()


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which pairs of shingle sets are similar, exactly; within left, or between left and right.

    Shingles that the same documents have are counted once with their number, so many
    near copies need few columns.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[by][1:] != flat[by][:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(flat)))
    who = mixed(np.arange(1, len(sets) + 1, dtype=U64))
    shared = counts > 1
    mark = np.add.reduceat(who[doc[by]], starts)[shared]
    _, one, weight = np.unique(mark, return_index=True, return_counts=True)
    starts, counts = starts[shared][one], counts[shared][one]
    n = len(left)
    common = np.zeros((n, len(right) if right is not None else n), np.float64)
    for at in range(0, len(starts), 2048):
        x = np.zeros((len(sets), len(starts[at : at + 2048])), np.float32)
        for c, (a, m) in enumerate(zip(starts[at : at + 2048].tolist(), counts[at : at + 2048].tolist(), strict=True)):
            x[doc[by[a : a + m]], c] = 1
        common += (x[:n] * weight[at : at + 2048].astype(np.float32)) @ (x[n:] if right is not None else x).T
    a, b = sizes[:n, None], (sizes[n:] if right is not None else sizes)[None, :]
    out = common >= similarity * (a + b - common) - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def verified(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(rep, hub, n) for rows (component, blocks, rep, copies, text): links counted by copies, and the smallest rep reached within each pair of blocks."""
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    dealt = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "text")

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rep = t.column("rep").to_numpy()
        t = t.filter(pa.array(np.concatenate([[True], rep[1:] != rep[:-1]])))  # repeated rows of one text
        rep, copies, first = t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("own").to_numpy() == i
        sets = [s for _, texts in slices(t.column("text").combine_chunks(), 1 << 20) for s in shingle_sets(texts, k)]
        if i == j:
            links = similar(sets, None, similarity)
        else:
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            links = np.zeros((len(sets), len(sets)), bool)
            if len(a) and len(b):
                part = similar([sets[x] for x in a], [sets[x] for x in b], similarity)
                links[np.ix_(a, b)], links[np.ix_(b, a)] = part, part.T
        n = links @ copies
        hub = rep[joined(links)]  # rows are sorted by rep
        some = n > 0
        if some.any():
            yield pa.RecordBatch.from_pydict({"rep": pa.array(rep[some]), "hub": pa.array(hub[some]), "n": pa.array(n[some].astype(np.int64))})

    return in_runs(dealt, ["component", "i", "j"], ["rep"], verify, "rep long, hub long, n long", least=2)


def linked(docs: DataFrame, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """(doc_id, n_links, component_id, kept): the number of other documents at least as similar, and the smallest doc_id reachable by links."""
    signed = materialise(signatures(docs, k))
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("low"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    # Numbers of classes stand in the order of their smallest doc_ids, so the smallest number reached leads to the smallest doc_id.
    ours = materialise(classes.select("key", F.col("low.doc_id").alias("low"), F.col("low.mark").alias("mark"), "copies", "n", "signature").orderBy("low", "key").withColumn("rep", F.monotonically_increasing_id()))
    edges = materialise(candidates(ours, similarity))
    groups = min_labels(edges).select(F.col("id").alias("rep"), "component").join(ours.select("rep", "low", "mark", "copies", "n"), "rep")
    sizes = groups.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    groups = groups.join(sizes, "component").select(F.col("low").alias("doc_id"), "mark", "rep", "component", "blocks", "copies")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").where("text IS NOT NULL").join(groups, ["doc_id", "mark"])
    found = materialise(verified(texts, k, similarity))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reach = min_labels(found.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).select(F.col("id").alias("rep"), "component")
    first = ours.select(F.col("rep").alias("component"), F.col("low").alias("first"))
    ends = ours.select("key", "rep", "copies", "low").join(n, "rep", "left").join(reach.join(first, "component"), "rep", "left")
    ends = ends.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("first", "low").alias("first"))
    component = F.coalesce("first", "doc_id")
    return signed.select("doc_id", "key").join(ends, "key", "left").select("doc_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


#: All pairs that share a shingle in DuckDB, for unique doc_ids.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + {K - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {K - 2}, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {SIMILARITY} * (x.n + y.n - c) - 1e-9),
reach(id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT near.b, reach.low FROM reach JOIN near ON near.a = reach.id),
c AS (SELECT id AS doc_id, min(low) AS component_id FROM reach GROUP BY 1),
l AS (SELECT a AS doc_id, count(*) AS n FROM near GROUP BY 1)
SELECT d.doc_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""


def brute_force(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, k: int = K) -> dict[int, tuple[int, int]]:
    """doc_id: (links, component) by all pairs, for tests."""
    sets = {}
    for d, t in rows:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids, near = sorted(sets), {d: set() for d in sets}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    label = {}
    for d in ids:
        todo = [] if d in label else [d]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = d
                todo += near[x]
    return {d: (len(near[d]), label[d]) for d in ids}
