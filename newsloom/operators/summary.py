"""Cluster summaries: the medoid by cosine to the normalised centroid, counts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import vector as V

from . import novelty as N


def centroids(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, centroid): the unit vector of the mean of unit vectors; sums are taken place by place, so they combine before the shuffle."""
    each = rows.select(*by, F.posexplode("unit").alias("i", "x"))
    mean = each.groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean")).select(*by, V.unit(F.col("mean")).alias("centroid"))


def summaries(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each cluster of rows (*by, news_id, embedding, novelty_label, published_at, title).

    The representative is the most central row; ties go by label, then date, then id.
    """
    n = V.norm(V.doubles(F.col("embedding")))
    units = rows.withColumn("unit", F.when(n == 0, V.doubles(F.col("embedding"))).otherwise(V.unit(F.col("embedding"))))
    central = units.join(centroids(units, by), by).withColumn("central", F.round(V.dot(F.col("unit"), F.col("centroid")), 12))
    best = F.min_by(F.struct("news_id", "title"), F.struct(-F.col("central"), -N.priority(F.col("novelty_label")), F.col("published_at"), F.col("news_id")))
    out = central.groupBy(*by).agg(best.alias("best"), F.count("*").alias("article_count"), F.min("published_at").alias("started_at"), F.max("published_at").alias("last_seen_at"))
    return out.select(*by, F.col("best.news_id").alias("representative_article_id"), F.col("best.title").alias("representative_title"), "article_count", "started_at", "last_seen_at")


def refreshed(old: DataFrame, new: DataFrame, affected: DataFrame, by: list[str]) -> DataFrame:
    """Old summaries without the affected clusters, and the new ones."""
    return old.join(affected.select(*by).distinct(), by, "left_anti").unionByName(new, allowMissingColumns=True)


def current(rows: DataFrame, by: list[str], *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
