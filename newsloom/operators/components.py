"""Connected components and distributed ranks.

Labels spread by alternating large-star and small-star rounds, so the number of rounds
grows with the logarithm of a component's size, and no task holds a component. Before
and after each round every task contracts the edges it has, in batches of bounded size, to
stars around its smallest ids; that only replaces paths by shorter ones. Edges are dealt to
as few tasks as hold BATCH edges each, so once BATCH or fewer are left one contraction ends
it. An id with more than HUB edges is spread over several tasks wherever edges are joined
by id. Each round is cut off with checkpoint(), which survives lost executors.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = 1 << 20  # edges that a task contracts at once
HUB = 1000  # edges of an id that are joined in one task


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; only a local session without one gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
        top = spark.sparkContext.getCheckpointDir()
    return top


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it back from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stars(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components: each id with the smallest one that these edges reach."""
    ids, index = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = index[: len(v)], index[len(v) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def contracted(edges: DataFrame) -> DataFrame:
    """(v, u) with u < v, of the same components as edges (v, u)."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            v, u = stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_pydict({"v": pa.array(v, pa.int64()), "u": pa.array(u, pa.int64())})

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BATCH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.select(F.col("v").cast("long"), F.col("u").cast("long")).where("v IS NOT NULL AND u IS NOT NULL").mapInArrow(contract, "v long, u long")


def _spread(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (v, u) joined with low (v, m, n), an id of n edges in one part for each HUB of them."""
    hubs = low.where(F.col("n") > HUB).select("v", F.ceil(F.col("n") / F.lit(HUB)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int")
    few = hubs.count() <= 100_000  # else the two sides are shuffled
    own = edges.join(F.broadcast(hubs) if few else hubs, "v", "left").select("v", "u", part.alias("part"))
    ways = low.select("v", "m", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest("n", F.lit(1)) / F.lit(HUB)).cast("int") - 1)).alias("part"))
    return own.join(ways, ["v", "part"]).drop("part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id of an edge the smallest id it reaches; edges from an id to itself count for nothing."""
    own = edges.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("u"))
    e, before = materialise(contracted(own.where("v <> u"))), None
    while True:
        n = e.count()
        if n <= BATCH:
            e = materialise(contracted(e.coalesce(1)))
            return e.select(F.col("v").alias("id"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
        both = e.union(e.select("u", "v").toDF("v", "u")).distinct()
        low = materialise(both.groupBy("v").agg(F.least("v", F.min("u")).alias("m"), F.count("*").alias("n")))
        large = _spread(both, low).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = materialise(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        ends = F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        e = _spread(large, low).select(F.explode(ends).alias("s")).select("s.v", "s.u").where("v <> u").distinct()
        e = materialise(contracted(e.repartition(max(-(-n // BATCH), 1))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component")).union(e.select("u", "u").distinct())
        before = now


def labelled(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """rows with ``component``: the smallest key reached; keys without an edge are their own."""
    found = components(edges).withColumnRenamed("id", key)
    return rows.join(found, key, "left").withColumn("component", F.coalesce("component", key))


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their 0-based rank in a total order: a range sort, and one offset for each partition."""
    place = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = place.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return place.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + at).drop("_part", "_before", "_at")


def cumulative(rows: DataFrame, sums: dict[str, str], *order: Column) -> DataFrame:
    """rows with running sums (new name: column) in a total order, both ends included: within range partitions, plus what stands before each."""
    place = materialise(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    totals = place.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = totals.select("_part", *[(F.sum(f"_{n}").over(Window.orderBy("_part")) - F.col(f"_{n}")).alias(f"_{n}") for n in sums])
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = place.join(F.broadcast(before), "_part")  # one row for each partition
    return out.select(*rows.columns, *[(F.sum(c).over(here) + F.col(f"_{n}")).alias(n) for n, c in sums.items()])


def ordered_hash(rows: DataFrame, value: str, *order: Column, block: int = 1000) -> DataFrame:
    """One row: a hash (sha256) of the strings of a column in order, taken block by block and then over the blocks."""
    level = ranked(rows.select(value, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), *[F.col(f"_o{i}") for i in range(len(order))]).select(F.col("rank").alias("n"), F.col(value).alias("h"))
    size = rows.count()
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda s: s["h"]), "")
        level = level.groupBy(F.floor(F.col("n") / block).alias("n")).agg(F.sha2(joined, 256).alias("h"))
        size = -(-size // block)
        if size <= 1:
            return level.select(F.col("h").alias("hash"))
