"""Story clusters: components of strong edges, and the conservative second pass.

The second pass lets each small cluster join one larger one, once and without chains, if
its best candidate has evidence and is clear of the second best by a margin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components as C
from . import pairs as P
from .components import materialise


def baseline(news: DataFrame, threshold: float = 0.82, days: float = 14) -> DataFrame:
    """(row_pos, news_id, component): component is the smallest row_pos of the story."""
    return C.labelled(news.select("row_pos", "news_id"), P.edges(news, threshold, days), "row_pos")


def numbered(clusters: DataFrame, news: DataFrame, prefix: str = "exp00b", digits: int = 5) -> DataFrame:
    """clusters with cluster_id: a prefix and the rank of the story by its first row in (published_at, row_pos)."""
    first = clusters.join(news.select("row_pos", "published_at"), "row_pos").groupBy("component").agg(F.min(F.struct("published_at", "row_pos")).alias("first"))
    rank = C.ranked(first, F.col("first.published_at"), F.col("first.row_pos"))
    return clusters.join(rank.select("component", F.concat(F.lit(prefix + "_"), F.lpad(F.col("rank").cast("string"), digits, "0")).alias("cluster_id")), "component")


def sources(clusters: DataFrame, source_max: int = 2) -> DataFrame:
    """(row_pos) of the clusters that may join another; selection takes pairs of these rows alone."""
    small = clusters.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") <= source_max)
    return materialise(clusters.join(small, "component", "left_semi").select("row_pos"))


def selection(pairs: DataFrame, clusters: DataFrame, min_similarity: float = 0.75, days: float = 7, source_max: int = 2, title_jaccard: float = 0.15, shared_numbers: int = 1, margin: float = 0.03, require_evidence: bool = True) -> DataFrame:
    """(source, target, ...): each small cluster's accepted target."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    c = clusters.select("row_pos", "component").join(sizes, "component")
    side = lambda p: c.select(F.col("row_pos").alias(f"{p}_row_pos"), F.col("component").alias(f"{p}_component"), F.col("size").alias(f"{p}_size"))
    near = pairs.where((F.col("similarity") >= min_similarity) & (F.col("days_diff") <= days)).join(side("left"), "left_row_pos").join(side("right"), "right_row_pos").where("left_component <> right_component")
    each = ["similarity", "days_diff", "title_jaccard", "shared_numbers_count"]
    way = lambda s, t: near.select(F.col(f"{s}_component").alias("source"), F.col(f"{t}_component").alias("target"), F.col(f"{s}_size").alias("source_size"), F.col(f"{t}_size").alias("target_size"), F.col(f"{s}_news_id").alias("source_news_id"), F.col(f"{t}_news_id").alias("target_news_id"), *each)
    both = way("left", "right").union(way("right", "left")).where((F.col("source_size") <= source_max) & (F.col("target_size") > F.col("source_size")))
    if require_evidence:
        both = both.where((F.col("title_jaccard") >= title_jaccard) | (F.col("shared_numbers_count") >= shared_numbers))
    best = F.min_by(F.struct("source_news_id", "target_news_id"), F.struct(-F.col("similarity"), "source_news_id", "target_news_id"))
    found = both.groupBy("source", "target").agg(F.first("source_size").alias("source_size"), F.first("target_size").alias("target_size"), best.alias("pair"), F.max("similarity").alias("best_similarity"), F.min("days_diff").alias("min_days_diff"), F.max("title_jaccard").alias("max_title_jaccard"), F.max("shared_numbers_count").alias("max_shared_numbers_count"))
    order = Window.partitionBy("source").orderBy(F.col("best_similarity").desc(), F.col("target_size").desc(), F.col("min_days_diff").asc(), F.col("target").asc())
    ranked = found.withColumn("n", F.row_number().over(order)).withColumn("second_best_similarity", F.lead("best_similarity").over(order))
    ranked = ranked.withColumn("margin", F.col("best_similarity") - F.col("second_best_similarity"))
    return ranked.where(F.col("n") == 1).where(F.col("margin").isNull() | (F.col("margin") >= margin)).select("source", "target", "source_size", "target_size", "pair.*", "best_similarity", "min_days_diff", "max_title_jaccard", "max_shared_numbers_count", "second_best_similarity", "margin")


def attached(clusters: DataFrame, selected: DataFrame) -> DataFrame:
    """Provenance: final cluster, method, parent, similarity and the component joined; one hop only."""
    s = selected.select(F.col("source").alias("component"), "target", "source_news_id", "target_news_id", "best_similarity")
    out = clusters.join(s, "component", "left")
    own = F.col("news_id") == F.col("source_news_id")
    return out.select(
        "row_pos", "news_id", F.col("component").alias("baseline_component"), F.coalesce("target", "component").alias("cluster"),
        F.when(F.col("target").isNull(), "baseline").otherwise("attach").alias("assignment_method"),
        F.when(own, F.col("target_news_id")).alias("assignment_parent_news_id"), F.col("best_similarity").alias("assignment_similarity"), F.col("target").alias("attached_to_component"),
    )
