"""Exact quantiles from a range sort instead of an aggregate that holds all values of a group.

Rows are ranked once in the order of group and value; a quantile is a rank within its
group, and the few ranks that are asked for are looked up. No task holds a group's values,
however large the group is. Values between two ranks are interpolated as ``percentile`` does.

Missing values count for nothing, and a group of them alone has null quantiles; a missing group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import materialise, ranked

FEW = 100_000  # wanted ranks that are broadcast; more are joined by a shuffle


def exact(rows: DataFrame, value: Column, wanted: dict[str, float], by: dict[str, Column] | None = None) -> DataFrame:
    """(*by, *wanted): for each group the quantile of each name; without groups one row."""
    by = by or {}
    groups = [c.alias(f"_g{i}") for i, c in enumerate(by.values())]
    names = [f"_g{i}" for i in range(len(by))]
    x = materialise(rows.select(*groups, value.cast("double").alias("v")))
    placed = materialise(ranked(x.where("v IS NOT NULL"), *[F.col(n).asc_nulls_first() for n in names], F.col("v")))
    sizes = placed.groupBy(*names).agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(wanted.values())])).alias("w")
    places = sizes.select(*names, "start", "n", at).select(*names, "start", "w.i", "w.at")
    ends = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("end")
    asked = materialise(places.select(*names, "start", "i", "at", ends).withColumn("rank", F.col("start") + F.col("end")))
    few = asked.count() <= FEW
    found = placed.select("rank", "v").join(F.broadcast(asked) if few else asked, "rank")
    low, high = F.min_by("v", "end"), F.max_by("v", "end")
    share = F.max("at") - F.min("end")
    value_ = F.when(F.min("end") == F.max("end"), low).otherwise((F.max("end") - F.max("at")) * low + share * high)
    each = found.groupBy(*names, "i").agg(value_.alias("q"))
    out = each.groupBy(*names).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(wanted)])
    if not by:
        return out
    every = x.select(*names).distinct()
    same = F.lit(True)
    for n in names:
        same = same & every[n].eqNullSafe(out[n])
    return every.join(out, same, "left").select(*[every[n].alias(c) for n, c in zip(names, by, strict=True)], *wanted)


def by_bins(rows: DataFrame, value: Column, share: float, by: list[str], name: str, bins: int = 1 << 16) -> DataFrame:
    """(*by, name): the exact quantile of each group, for rows that are cheaper to make twice than to send.

    Rows are counted by bins of width 1 / bins first; then the values of the bins that hold the wanted ranks are counted.
    """
    x = rows.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL").withColumn("bin", F.floor(F.col("v") * bins))
    counts = materialise(x.groupBy(*by, "bin").agg(F.count("*").alias("k")))
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(*by, "bin", "k", (F.sum("k").over(upto) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy(*by)).alias("n"))
    at = (F.col("n") - 1) * F.lit(float(share))
    held = materialise(placed.select("*", F.floor(at).alias("low"), F.ceil(at).alias("high"), at.alias("at")).where("low < before + k AND high >= before").drop("k", "n"))
    few = held.count() <= FEW
    found = x.join(F.broadcast(held) if few else held, [*by, "bin"])
    values = found.groupBy(*by, "bin", "v", "before", "low", "high", "at").agg(F.count("*").alias("k"))
    inside = F.sum("k").over(Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    each = values.withColumn("upto", F.col("before") + inside).where("low < upto AND high >= upto - k").groupBy(*by).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max("at").alias("at"), F.max("low").alias("low"))
    part = F.col("at") - F.col("low")
    return each.select(*by, F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias(name))
