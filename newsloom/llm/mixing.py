"""Operator 1: mixing sources to target weights by the cube method.

A source's ratio of target to size splits into whole repeats of all its documents and a
fraction, the probability with which each document is taken once more. Those fractions
are settled by the cube method: inclusion probabilities move along the null space of the
balancing equations (tokens and documents) until almost all are 0 or 1. A flight runs in
each block of about BLOCK documents; the at most two that a block leaves open fly again
with those of other blocks, level by level, until a source is one block. There the flight
leaves LAND documents and what it can't settle to the landing, which tries every outcome
and takes the one nearest to the totals of tokens and documents. Flights keep every
probability; the landing gives that up for those few documents, as one that keeps it can
be off by the size of a source's largest document.

Only (doc_id, source, size) and a hash are shuffled, never a text. Blocks follow a hash of
doc_id and text, so a source or a doc_id with a third of all rows is split like any other,
and reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is
a source of its own, sorted last; repeated rows and rows without doc_id are documents of
their own; a very long text is one document, counted whole; extra columns are ignored; an
empty table gives no row; if all sizes are 0, so are all targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import cumulative, ranked

from .common import WORD, in_runs, materialise

BLOCK, FAN, LAND, FEW_SOURCES = 10_000, 2_000, 12, 10_000


def flight(p: list[float], size: list[float], draws: np.ndarray, landing: bool) -> list[float]:
    """Move probabilities p to 0 or 1 so that sum(p) and sum(p * size) stay; at most two stay open.

    For a landing, LAND documents stay on the ground, half of them the largest and half
    spread over the sizes; with what the flight leaves open they take the outcome, of all
    there are, nearest to both totals. Adding these documents one by one passes the total of
    tokens by half the largest at most, so the outcome taken ends no farther from it.
    """
    eps, p, at, n = 1e-9, list(p), 0, 0
    todo = [i for i, x in enumerate(p) if eps < x < 1 - eps]
    ground: list[int] = []
    if landing:
        by_size = sorted(todo, key=lambda i: size[i])
        rest, ground = by_size[: -LAND // 2], by_size[-LAND // 2 :]  # what matters most, and an even spread of the rest
        if rest:
            ground += [rest[i] for i in sorted(set(np.linspace(0, len(rest) - 1, min(LAND // 2, len(rest))).astype(int).tolist()))]
        todo = sorted(set(todo) - set(ground))
    tokens, documents = sum(a * b for a, b in zip(p, size, strict=True)), sum(p)
    open_: list[int] = []
    while True:
        while len(open_) < 3 and at < len(todo):
            open_.append(todo[at])
            at += 1
        if len(open_) == 3:
            i, j, k = open_
            u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min([(1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(open_, u, strict=True) if d])
        down = min([p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(open_, u, strict=True) if d])
        step = up if draws[n] * (up + down) < down else -down  # each step settles a document, so draws suffice
        n += 1
        left = []
        for i, d in zip(open_, u, strict=True):
            p[i] += step * d
            if p[i] <= eps:
                p[i] = 0.0
            elif p[i] >= 1 - eps:
                p[i] = 1.0
            else:
                left.append(i)
        open_ = left
    if landing and (open_ := open_ + ground):
        own = np.array([size[i] for i in open_], np.float64)
        outcome = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
        token_gap = np.abs(outcome @ own - sum(p[i] * size[i] for i in open_)) / max(tokens, 1)
        document_gap = np.abs(outcome.sum(1) - sum(p[i] for i in open_)) / max(documents, 1)
        for i, x in zip(open_, outcome[int((token_gap + document_gap / 100).argmin())].tolist(), strict=True):
            p[i] = float(x)
    return [0.0 if x <= eps else 1.0 if x >= 1 - eps else x for x in p]


def targets(sizes: DataFrame, repeats: int = 3, weights: int = 3) -> DataFrame:
    """(source, source_size, n, sid, target) for rows (source, source_size, n).

    Shares follow the weights, and no target exceeds ``repeats`` times the source's
    size. In order of size by weight, a source is full if its cap is under its share
    of what the full ones before it leave; the first that isn't sets the level for all
    after it. Places and running sums are range sorts, so sources may be many.
    """
    s = ranked(sizes, F.col("source").asc_nulls_last(), name="sid").withColumn("sid", F.col("sid") + 1).withColumn("w", (F.col("sid") - 1) % weights + 1)
    s = s.withColumn("cap", F.col("source_size").cast("double") * repeats).withColumn("r", F.col("cap") / F.col("w"))
    s = cumulative(s, {"cap_sum": "cap", "w_sum": "w"}, F.col("r"), F.col("sid"))
    all_ = s.agg(F.sum(F.col("source_size").cast("double")).alias("total"), F.sum("w").alias("w_total"))
    s = s.crossJoin(F.broadcast(all_))  # one row
    s = s.withColumn("rest", F.col("total") - F.col("cap_sum") + F.col("cap")).withColumn("w_rest", F.col("w_total") - F.col("w_sum") + F.col("w"))
    s = s.withColumn("full", F.col("r") * F.col("w_rest") <= F.col("rest"))
    level = s.where("NOT full").agg(F.min_by(F.col("rest") / F.col("w_rest"), F.struct("r", "sid")).alias("level"))
    s = s.crossJoin(F.broadcast(level))  # one row
    return s.select("source", "source_size", "n", "sid", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame, key: list[str] | None = None, seed: int = 7) -> DataFrame:
    """(*key, source, size, source_size, target, copies, taken) for each row of docs."""
    key = key or ["doc_id"]
    sized = materialise(docs.select(*key, "source", n_words().alias("size"), F.xxhash64(*key, "text", F.lit(seed)).alias("spread")))
    plan = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))))
    few = plan.count() <= FEW_SOURCES  # else the two sides are shuffled
    rows = sized.join(F.broadcast(plan) if few else plan, sized.source.eqNullSafe(plan.source)).drop(plan.source)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + F.lit(1e-9)).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(ratio - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK))).withColumn("block", F.pmod(F.col("spread"), F.col("blocks")))
    kept = [*key, "source", "size", "source_size", "target", "whole", "sid", "blocks", "spread"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept, "block", "p").schema)
    most = plan.agg(F.max("n")).first()[0] or 0
    done, level = None, 0
    blocks = -(-most // BLOCK)  # of the largest source
    while True:
        last = blocks <= 1

        def fly(t: pa.Table, level: int = level) -> Iterator[pa.RecordBatch]:
            draws = np.random.default_rng([seed, level, t.column("sid")[0].as_py(), t.column("block")[0].as_py()]).random(t.num_rows + 2)
            p = flight(t.column("p").to_pylist(), t.column("size").to_pylist(), draws, t.column("blocks")[0].as_py() <= 1)
            out = t.set_column(t.column_names.index("p"), "p", pa.array(p, pa.float64()))
            yield from out.combine_chunks().to_batches()

        flown = materialise(in_runs(rows.select(*kept, "block", "p"), ["sid", "block"], ["size", *key, "spread"], fly, kinds))
        settled = flown if last else flown.where("p = 0 OR p = 1")
        done = settled if done is None else done.union(settled)
        if last:
            break
        rows = flown.where("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("long")).withColumn("blocks", F.ceil(F.col("blocks") / F.lit(FAN)))
        blocks, level = -(-blocks // FAN), level + 1
    copies = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    return done.select(*key, "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
