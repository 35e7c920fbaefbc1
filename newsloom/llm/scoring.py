"""Operator 8: language-model scores of whole texts.

The model's core is causal self-attention over all subword ids (``attention``): each id of
each text is predicted from the ids before it, in overlapping windows, each place once, in
batches of masked attention. A word's probability is the even mixture of two, both
conditional on all that stands before it:

* its spelling, id by id, and that the next id begins a word again;
* the class of its first id by the same attention, and its share of that class's training
  count, which is 0 for a word that no training document has.

Each sums to at most one over all words, and so does the mixture. The counts grow with
the corpus and remember its words; the spelling gives new ones a probability.

Attention learns from every id of every training document with the context that it has in
scoring. A chunk of documents is one learner: in each round it trains from the present
weights on its windows of the round, and the weights are averaged, in whole numbers, so
that neither the order of the sum nor the number of partitions changes them. There are
ROUNDS rounds; a corpus with fewer than ENOUGH training ids is read several times in
them, PASSES at most, any other once.

Chunks send the hashes and counts of their distinct words, parts add them up and answer
with the totals in the same order: 12 bytes for each distinct word of a chunk, never one
row for each word. Two different words share a 64-bit hash with a chance of 2^-64, and then
their count. No vocabulary of words is broadcast or sent to the driver.

Defined results: a null or empty text is the end token alone; without training documents
the counts are 0, the base score is 0 and every word is spelled by the untrained model;
rows without doc_id are told apart by crc32("None"); repeated rows are documents like
others; a very long text is scored whole; extra columns are ignored; an empty table gives
no row; special strings inside texts are ordinary text here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import U64, Words, chunked, materialise, partitions
from .tokens import WordEncoder

FOLDS, HELD_OUT, ROUNDS, RATE = 7, 2, 8, 0.03
ENOUGH, PASSES = 8_000_000, 8  # training ids, and passes over fewer
HELD = 30_000  # windows that a learner holds at a time
UNIT, PART = 1 << 16, 1024  # weights are averaged in whole numbers of 1 / UNIT, PART of them in a row
END_WORD = 0x9E3779B97F4A7C15  # the hash that stands for the end token


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Tokens:
    """The lower-case words of a chunk, an end after each document, and its distinct ones with training counts in the order in which they are sent."""

    def __init__(self, doc_ids: list[int], texts: list[str | None], parts: int):
        self.words = w = Words(texts, lower=True)
        self.sizes = w.counts + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        all_ = np.insert(w.hash, np.cumsum(w.counts), U64(END_WORD))
        training = np.repeat(np.array([not held_out(d) for d in doc_ids], bool), self.sizes)
        distinct, index = np.unique(all_, return_inverse=True)
        part = ((distinct >> U64(33)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.index = place[index]
        self.hash = distinct[order]
        self.count = np.bincount(self.index[training], minlength=len(order)).astype(np.uint32)
        self.cuts = np.searchsorted(part[order], np.arange(parts + 1))

    def spelling(self, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct tokens one after the other, and how many each has; every distinct word is encoded once."""
        ends = np.zeros(len(self.index), bool)
        ends[self.first + self.sizes - 1] = True
        number = np.arange(len(self.index)) - np.cumsum(ends)  # of each word among all words
        some = np.full(len(self.hash), -1, np.int64)
        some[self.index[~ends]] = number[~ends]
        raw, start, end = self.words.raw, self.words.start, self.words.end
        places = np.flatnonzero(some >= 0)
        words = [raw[a:z] for a, z in zip(start[some[places]].tolist(), end[some[places]].tolist(), strict=True)]
        ids = [b""] * len(some)
        for j, x in zip(places.tolist(), map(encoder.__getitem__, words), strict=True):
            ids[j] = x
        encoder.forget(words)
        last = np.array([encoder.end], encoder.dtype).tobytes()
        for j in np.flatnonzero(some < 0).tolist():
            ids[j] = last
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.dtype.itemsize
        return np.frombuffer(b"".join(ids), encoder.dtype).astype(np.int64), lengths


def scored(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score) of every document; the last is that of the spelling alone."""
    chunks, _, size = chunked(docs, 4 << 20, least=8)
    n = partitions(docs.sparkSession)
    parts = max(16, size // (64 << 20))

    def gather(t: pa.Table) -> pa.Table:
        """Word counts by part, and all ids of the training documents with each one's number of them (part -1)."""
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        chunk, doc_ids, texts = t.column("chunk")[0].as_py(), t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        w = Tokens(doc_ids, texts, parts)
        rows = [(p, chunk, w.hash[a:z].tobytes(), w.count[a:z].tobytes(), z - a) for p, (a, z) in enumerate(zip(w.cuts.tolist(), w.cuts[1:].tolist(), strict=False)) if z > a]
        encoder = WordEncoder.of(vocabulary, special=False)
        ids, lengths = w.spelling(encoder)
        training = np.array([not held_out(d) for d in doc_ids], bool)
        doc = np.repeat(np.arange(len(doc_ids)), w.sizes)
        index = w.index[training[doc]]
        n = lengths[index]
        at = np.repeat((np.cumsum(lengths) - lengths)[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        places = np.bincount(doc, lengths[w.index], len(doc_ids)).astype(np.int64)[training]
        rows.append((-1, chunk, zstandard.ZstdCompressor(level=1).compress(ids[at].astype(encoder.dtype).tobytes()), places.tobytes(), len(at)))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["part", "chunk", "data", "counts", "n"])

    def total(t: pa.Table) -> pa.Table:
        """Each word's count over all chunks, in the order of each chunk; and the sums of the part (chunk -1)."""
        h = [np.frombuffer(x, U64) for x in t.column("data").to_pylist()]
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()])
        distinct, index = np.unique(np.concatenate(h), return_inverse=True)
        sums = np.bincount(index, c, len(distinct)).astype(np.uint64)
        out = np.split(sums[index], np.cumsum([len(x) for x in h])[:-1])
        small = lambda x: x.astype(np.uint32).tobytes() if len(x) == 0 or x.max() < 1 << 32 else x.tobytes()
        rows = [(c, p, small(x), 0, 0) for c, p, x in zip(t.column("chunk").to_pylist(), t.column("part").to_pylist(), out, strict=True)]
        rows.append((-1, rows[0][1], b"", int(sums.sum()), int((sums > 0).sum())))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["chunk", "part", "data", "n", "v"])

    gathered = materialise(chunks.groupBy("chunk").applyInArrow(gather, "part int, chunk int, data binary, counts binary, n long"))
    answers = materialise(gathered.where("part >= 0").select("part", "chunk", "data", "counts").repartition(n, "part").groupBy("part").applyInArrow(total, "chunk int, part int, data binary, n long, v long"))
    tokens, distinct = (x or 0 for x in answers.where("chunk = -1").agg(F.sum("n"), F.sum("v")).first())
    classes, weights, class_counts = fit(gathered.where("part = -1").select("chunk", "data", "counts", "n"), vocabulary, rounds, rate)
    ln_class = np.log(np.maximum(class_counts, 1))

    def score(t: pa.Table, counts: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        doc_ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        w, encoder = Tokens(doc_ids, texts, parts), WordEncoder.of(vocabulary, special=False)
        c = np.zeros(len(w.hash), np.uint64)
        for p, x in zip(counts.column("part").to_pylist(), counts.column("data").to_pylist(), strict=True):
            a, z = w.cuts[p], w.cuts[p + 1]
            c[a:z] = np.frombuffer(x, np.uint32 if len(x) == 4 * (z - a) else np.uint64)
        doc = np.repeat(np.arange(len(doc_ids)), w.sizes)
        known = np.bincount(doc, (c > 0)[w.index], len(doc_ids)).astype(np.int64)
        base = np.bincount(doc, np.log10((c.astype(np.float64) + 1) / (tokens + distinct + 1))[w.index], len(doc_ids))
        ids, lengths = w.spelling(encoder)
        starts, lm, alone = np.cumsum(lengths) - lengths, np.zeros(len(doc_ids)), np.zeros(len(doc_ids))
        for at in range(0, len(doc_ids), 200):
            sizes = w.sizes[at : at + 200]
            a = w.first[at]
            index, token_doc = w.index[a : a + sizes.sum()], np.repeat(np.arange(len(sizes)), sizes)
            n = lengths[index]
            end = np.cumsum(n)
            word = np.repeat(np.arange(len(index)), n)
            flat = ids[starts[index][word] + np.arange(len(word)) - (end - n)[word]]
            y = classes.of[flat]
            p, b = attention.score(weights, classes, y, np.bincount(token_doc, n, len(sizes)).astype(np.int64))
            first = p[end - n] - b[end - n]  # a word begins where one can
            after = np.append(b[end[:-1]], 0.0)
            after[np.cumsum(sizes) - 1] = 0.0  # nothing follows the end
            spelled = first + np.add.reduceat(p, end - n) - p[end - n] + np.add.reduceat(classes.within[flat], end - n) + after
            own = c[index].astype(np.float64)
            with np.errstate(divide="ignore"):
                shared = first + np.log(own) - ln_class[y[end - n]]
            lm[at : at + 200] = np.bincount(token_doc, np.logaddexp(spelled, shared) - np.log(2), len(sizes)) / np.log(10)
            alone[at : at + 200] = np.bincount(token_doc, spelled, len(sizes)) / np.log(10)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": [held_out(d) for d in doc_ids], "n_tokens": w.sizes, "n_known": known, "train_tokens": pa.array([tokens] * len(doc_ids), pa.int64()), "base_score": base, "score": lm, "spelled_score": alone})

    replies = answers.where("chunk >= 0").select("chunk", "part", "data")
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double"
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, kinds)


def fit(samples: DataFrame, vocabulary: str, rounds: int, rate: float) -> tuple[attention.Classes, np.ndarray, np.ndarray]:
    """Classes, weights, and the training words whose first id is of each class, from rows (chunk, data, counts, n) of training ids.

    Only vocabulary- and model-sized results reach the driver.
    """
    encoder = WordEncoder.of(vocabulary, special=False)
    end, kind = encoder.end, encoder.dtype

    def opened(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("data").to_pylist():
                c = np.bincount(opened(x), minlength=len(total))
                c[: len(total)] += total
                total = c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    counts = np.zeros(end + 1, np.int64)
    for r in samples.select("data").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    classes = attention.Classes.by_counts(counts, encoder.begins, end)
    weights = attention.start(np.bincount(classes.of, counts, classes.n))
    first = np.bincount(classes.of[encoder.begins], counts[encoder.begins], classes.n)
    passes = min(max(-(-ENOUGH // max(int(counts.sum()), 1)), 1), PASSES) if counts.any() else 0
    each = max(rounds // max(passes, 1), 1)  # rounds of a pass

    for r in range(passes * each):

        def learn(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights, r: int = r) -> Iterator[pa.RecordBatch]:
            total, seen, place = np.zeros(attention.WEIGHTS, np.int64), 0, np.arange(attention.WINDOW)
            for b in batches:
                for chunk, data, sizes in zip(*(b.column(c).to_pylist() for c in ("chunk", "data", "counts")), strict=True):
                    y, lengths = classes.of[opened(data)], np.frombuffer(sizes, np.int64)
                    if not len(y):
                        continue
                    x, starts = attention.inputs(y, lengths, classes.end)
                    doc, begin, skip = (part[r % each :: each] for part in attention.windows(lengths))
                    p = weights
                    for a in range(0, len(doc), HELD):
                        d, at = doc[a : a + HELD], begin[a : a + HELD, None] + place
                        real = at < lengths[d][:, None]
                        at = starts[d][:, None] + np.where(real, at, 0)
                        p = attention.train(p, x[at], y[at], real & (place >= skip[a : a + HELD, None]), rate * (1 - r / (passes * each)), seed=chunk * 1000 + r)
                    total += np.round(p.astype(np.float64) * UNIT).astype(np.int64) * len(doc)
                    seen += len(doc)
            if seen:
                blocks = [total[i : i + PART].tobytes() for i in range(0, len(total), PART)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "w": pa.array(blocks, pa.binary()), "n": pa.array([seen] * len(blocks), pa.int64())})

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.int64) for x in t.column("w").to_pylist())
            return pa.table({"block": t.column("block").slice(0, 1), "w": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

        kinds = "block int, w binary, n long"
        new = sorted(map(tuple, samples.mapInArrow(learn, kinds).groupBy("block").applyInArrow(add, kinds).collect()))
        if new:
            weights = np.concatenate([np.frombuffer(w, np.int64) / (n * UNIT) for _, w, n in new]).astype(np.float32)
    return classes, weights, first
