"""Data-quality reports, distributions and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

from . import quantiles as Q


def quality(rows: DataFrame, min_words: int = 20) -> DataFrame:
    """One row: blanks, duplicates by text and url, short texts."""
    blank = lambda c: F.count_if(F.trim(T.safe_text(F.col(c))) == "")
    return rows.agg(F.count("*").alias("rows"), blank("title").alias("blank_titles"), blank("text").alias("blank_texts"), (F.count("text") - F.countDistinct("text")).alias("duplicate_texts"), (F.count("title") - F.countDistinct("title")).alias("duplicate_titles"), F.count_if(T.space_word_count(F.col("text")) < min_words).alias("short_texts"))


def missing_share(rows: DataFrame) -> DataFrame:
    shares = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in rows.columns])
    return shares.unpivot([], list(rows.columns), "column", "share")


def described(rows: DataFrame, value: str, quantiles: tuple[float, ...]) -> DataFrame:
    wanted = {f"q{int(1000 * x)}": x for x in quantiles}
    out = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    return out.crossJoin(F.broadcast(Q.exact(rows, F.col(value), wanted)))  # one row


def after_quantile(rows: DataFrame, share: float) -> DataFrame:
    """Rows dated at or after the given quantile of all dates; the quantile is one value."""
    cut = Q.exact(rows, F.unix_micros("published_at"), {"cut": share})
    return rows.crossJoin(F.broadcast(cut)).where(F.unix_micros("published_at") >= F.col("cut")).drop("cut")


def per_day(rows: DataFrame, ts: str = "published_at") -> DataFrame:
    """(day, n) for every day between the first and the last; days without rows have 0."""
    day = F.date_trunc("day", F.col(ts))
    n = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    days = n.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def lengths(rows: DataFrame, by: Column, name: str, value: Column) -> DataFrame:
    return with_quantiles(rows, {name: by}, value, {"median": 0.5, "p90": 0.9, "p99": 0.99}, F.avg("v").alias("mean"))


def with_quantiles(rows: DataFrame, by: dict[str, Column], value: Column, wanted: dict[str, float], *aggregates: Column) -> DataFrame:
    """(*by, *aggregates, *wanted): aggregates are over v, the value, and the columns of rows."""
    out = rows.withColumn("v", value).groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(by.values())]).agg(*aggregates)
    q = Q.exact(rows, value, wanted, by)
    same = F.lit(True)
    for i, n in enumerate(by):
        same = same & out[f"_k{i}"].eqNullSafe(q[n])
    return out.join(q, same).drop(*[f"_k{i}" for i in range(len(by))])


def cluster_stats(rows: DataFrame, order: list[str]) -> DataFrame:
    """Size, most frequent topic (ties to the smallest), dates and first title."""
    topic = rows.groupBy("cluster", "topic").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.min_by("topic", F.struct(-F.col("k"), "topic")).alias("topic"))
    out = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.min_by("title", F.struct(*order)).alias("first_title"))
    return out.join(topic, "cluster")


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return rows.groupBy(a).pivot(b, values).count().na.fill(0)


def binned(rows: DataFrame, label: Column, labels: list[str]) -> DataFrame:
    """Counts of bins, empty ones too."""
    bins = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "bin_order long, bin string")
    n = rows.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(n, "bin", "left").select("bin_order", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Cumulative counts of value <= edge."""
    counts = rows.agg(*[F.count_if(F.col(value) <= e).alias(str(i)) for i, e in enumerate(edges)])
    out = counts.unpivot([], [str(i) for i in range(len(edges))], "i", "n")
    at = reduce(lambda x, ie: F.when(F.col("i") == str(ie[0]), float(ie[1])).otherwise(x), enumerate(edges), F.lit(None).cast("double"))
    return out.select(at.alias("le"), "n")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same for any partitioning."""
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).orderBy("_h", key).limit(n).drop("_h")


def error_sample(pairs: DataFrame, truth: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """At most n of the pairs (a, b) whose rows have different truths (row_pos, truth), in the order of a seeded md5, so that other engines draw the same."""
    side = lambda c: truth.select(F.col("row_pos").alias(c), F.col("truth").alias(f"truth_{c}"))
    return error_sample_of(pairs.join(side("a"), "a").join(side("b"), "b"), n, seed)


def error_sample_of(pairs: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """The same of pairs (a, b, truth_a, truth_b)."""
    wrong = pairs.where("truth_a <> truth_b")
    return wrong.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "a", "b")), "a", "b").limit(n)


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``is_validation`` by a hash of a group key, so that a group is never divided."""
    return rows.withColumn("is_validation", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000))


def stratified(rows: DataFrame, strata: list[str], total: int, *order: Column) -> DataFrame:
    """An equal quota of each stratum in order, topped up from the rest."""
    groups = rows.select(*strata).distinct().count()
    quota = -(-total // max(groups, 1))
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return n.orderBy((F.col("_n") > quota), *order).limit(total).drop("_n")


def batches(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    from .components import ranked

    return ranked(rows, *order, name="_rank").withColumn("batch", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def contiguous(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """``part`` from 1 to n in order, of sizes that differ by one at most, larger ones first."""
    from .components import ranked

    x = ranked(rows, *order, name="_rank").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all"))))
    size, more = F.floor(F.col("_all") / n), F.col("_all") % n
    early = F.floor(F.col("_rank") / (size + 1)) + 1
    late = more + F.floor((F.col("_rank") - more * (size + 1)) / F.greatest(size, F.lit(1))) + 1
    return x.withColumn("part", F.when(F.col("_rank") < more * (size + 1), early).otherwise(late).cast("long")).drop("_rank", "_all")


def budgeted(clusters: DataFrame, least: int, most: int, *order: Column) -> DataFrame:
    """Clusters taken in order while their sizes fit ``most``, until ``least`` is reached.

    A cluster has a row at least, so ``most`` candidates decide as long as all of them fit
    the room that is left; if some don't, those behind them that do are read next. The
    driver never sees more than ``most`` clusters at once.
    """
    from .components import ranked

    placed = ranked(clusters.where((F.col("size") > 0) & (F.col("size") <= most)).select("cluster", "size"), *order, name="_place")
    taken, n, at = [], 0, -1
    while n < least:
        rows = placed.where((F.col("_place") > at) & (F.col("size") <= most - n)).orderBy("_place").limit(most).collect()
        for r in rows:
            at = r["_place"]
            if n < least and n + r["size"] <= most:
                n += r["size"]
                taken.append((r["cluster"],))
        if len(rows) < most:
            break
    return clusters.sparkSession.createDataFrame(taken, clusters.select("cluster").schema)
