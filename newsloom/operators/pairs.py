"""Similarity joins within a topic and a band of time.

Pairs meet by topic and time bucket: buckets are as wide as the window, and the earlier
row goes to its own bucket and the next, so each pair in the window meets exactly once and
a hot topic is split by time. Cosines are taken in blocks (``tiles``), evidence after the cosine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import vector as V

from . import tiles
from .sets import Sets, marks

DAY = 86_400_000_000


def vectorised(news: DataFrame) -> DataFrame:
    """Unit vectors and sets, once for each row."""
    return news.withColumn("unit", V.unit(F.col("embedding"))).withColumn("title_tokens", T.tokens(F.col("title"))).withColumn("text_tokens", T.tokens(F.col("text"))).withColumn("numbers", T.numbers(F.col("title"), F.col("text")))


def in_band(news: DataFrame, days: float, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """All (left, right) rows of equal ``by`` with 0 <= right - left <= days, left first in (published_at, row_pos)."""
    by, width = by if by is not None else ["topic"], int(days * DAY)
    micros = F.unix_micros("published_at")
    bucket = F.floor(micros / F.lit(width)).cast("long")
    keep = [*dict.fromkeys(["news_id", "published_at", "row_pos", *columns])]
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in keep]
    left = news.select(*by, *side("left"), micros.alias("_l"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    right = news.select(*by, *side("right"), micros.alias("_r"), bucket.alias("_bucket"))
    ordered = (F.col("_l") < F.col("_r")) | ((F.col("_l") == F.col("_r")) & (F.col("left_row_pos") < F.col("right_row_pos")))
    out = left.join(right, [*by, "_bucket"]).where(ordered & (F.col("_r") - F.col("_l") <= width))
    return out.withColumn("days_diff", (F.col("_r") - F.col("_l")) / F.lit(float(DAY))).drop("_bucket", "_l", "_r")


def cluster_candidates(new: DataFrame, history: DataFrame, strong: float = 0.82, attach: float = 0.75, days: float = 14, attach_days: float = 7, title_jaccard: float = 0.15, shared_numbers: int = 1) -> DataFrame:
    """For each new row the stored clusters (cluster_id, component_id) that it may join: by a strong row, or by evidence within the shorter window.

    One row for each (news_id, cluster_id): whether a row is strong, the best similarity, the
    least days, the parent (most similar, then by title, numbers and days) and the
    components of its strong rows.
    """
    x = tiles.similar_to(new, history, min(strong, attach), days).withColumnsRenamed({"new": "new_news_id", "old": "old_news_id"})
    tokens = lambda df, p, *more: df.select(F.col("news_id").alias(f"{p}_news_id"), T.tokens(F.col("title")).alias(f"{p}_title"), T.numbers(F.col("title"), F.col("text")).alias(f"{p}_numbers"), *[F.col(c).alias(f"{p}_{c}") for c in more])
    x = x.join(tokens(new, "new"), "new_news_id").join(tokens(history, "old", "cluster_id", "component_id"), "old_news_id")
    x = x.withColumn("title", T.jaccard(F.col("new_title"), F.col("old_title"))).withColumn("shared", F.size(F.array_intersect("new_numbers", "old_numbers"))).withColumn("is_strong", F.col("similarity") >= strong)
    evidence = (F.col("similarity") >= attach) & (F.col("days_diff") <= attach_days) & ((F.col("title") >= title_jaccard) | (F.col("shared") >= shared_numbers))
    best = F.struct(-F.col("similarity"), -F.col("title"), -F.col("shared"), "days_diff", "old_news_id")
    return x.where(F.col("is_strong") | evidence).groupBy(F.col("new_news_id").alias("news_id"), F.col("old_cluster_id").alias("cluster_id")).agg(
        F.bool_or("is_strong").alias("strong"), F.max("similarity").alias("similarity"), F.min("days_diff").alias("days"), F.min_by("old_news_id", best).alias("parent"), F.array_sort(F.collect_set(F.when(F.col("is_strong"), F.col("old_component_id")))).alias("components")
    )


def edges(news: DataFrame, threshold: float = 0.82, days: float = 14, by: list[str] | None = None, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b, similarity, days_diff): pairs of row_pos at least as similar as threshold.

    score(similarity, days) may lower the similarity before it is compared.
    """
    out = tiles.similar(news, threshold, days, by)
    return out.where(score(F.col("similarity"), F.col("days_diff")) >= threshold) if score else out


def candidate_pairs(news: DataFrame, min_similarity: float = 0.75, days: float = 14, of: DataFrame | None = None) -> DataFrame:
    """Pairs with evidence: similarity, days, Jaccard of titles and texts, shared numbers.

    Evidence is taken where the cosines are, from marks of the words that go to the tiles with each row, so no
    pair is sent with words. of (row_pos): only pairs with one of these rows, as left; a pair of two of them stands in both orders.
    """
    own = {"title_jaccard": T.tokens(F.col("title")), "text_jaccard": T.tokens(F.col("text")), "shared_numbers_count": T.numbers(F.col("title"), F.col("text"))}
    sets = news.select(F.col("row_pos").alias("key"), F.col("news_id").alias("_id"), F.col("topic").alias("_topic"), *[marks(x).alias(c) for c, x in own.items()])
    size = news.agg(F.avg(F.length("title") + F.length("text"))).first()[0] or 0  # words are shorter than 8 bytes, but repeat
    rows = tiles.prepared(news, ["topic"], "row_pos", int(of is not None))
    if of is not None:
        rows = tiles.prepared(news.join(of.select("row_pos"), "row_pos", "left_semi"), ["topic"], "row_pos").union(rows)
    join = tiles.Join(rows, days, ["topic"], min_similarity, sides=of is not None)
    key = join.key_type

    def look(t: pa.Table, start: int) -> tuple[None, tiles.Also]:
        held = {c: Sets(t.column(c), start) for c in ("title_jaccard", "text_jaccard", "shared_numbers_count")}
        ids, topics = t.column("_id").combine_chunks(), t.column("_topic").combine_chunks()

        def evidence(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[str, pa.Array]:
            return {
                "left_news_id": ids.take(pa.array(left)), "right_news_id": ids.take(pa.array(right)), "topic": topics.take(pa.array(left)),
                "title_jaccard": pa.array(held["title_jaccard"].jaccards(x, y)), "text_jaccard": pa.array(held["text_jaccard"].jaccards(x, y)), "shared_numbers_count": pa.array(held["shared_numbers_count"].common(x, y)),
            }

        return None, evidence

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    found = join.result(
        f"left_row_pos {key}, right_row_pos {key}, similarity double, days_diff double, left_news_id {kinds['_id']}, right_news_id {kinds['_id']}, topic {kinds['_topic']}, title_jaccard double, text_jaccard double, shared_numbers_count long",
        lambda a, b, s, d: pa.table({"left_row_pos": a, "right_row_pos": b, "similarity": s, "days_diff": d}), sets, size, look,
    )
    found = found if of is None else found.where("left_row_pos <> right_row_pos")
    return found.select("left_row_pos", "right_row_pos", "left_news_id", "right_news_id", "topic", "similarity", "days_diff", "title_jaccard", "text_jaccard", "shared_numbers_count")


def mutual_neighbours(news: DataFrame, k: int, days: float, threshold: float) -> DataFrame:
    """Edges whose ends are among each other's k most similar rows in the window."""
    found = edges(news, threshold, days)
    both = found.select("a", "b", "similarity").union(found.select("b", "a", "similarity"))
    best = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), F.col("b").asc()))).where(F.col("n") <= k)
    return best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select("x.a", "x.b", "x.similarity")


def fallback_previous(news: DataFrame, clusters: DataFrame, days: float = 30, threshold: float = 0.78, k: int = 10) -> DataFrame:
    """For each row the k most similar earlier rows of its topic in other clusters (row_pos, cluster_id)."""
    own = clusters.select("row_pos", "cluster_id")
    near = tiles.similar(news.join(own, "row_pos"), threshold, days).where("days_diff > 0").withColumnsRenamed({"a": "left_row_pos", "b": "right_row_pos"})
    side = lambda p: own.toDF(f"{p}_row_pos", f"{p}_cluster_id")
    out = near.join(side("left"), "left_row_pos").join(side("right"), "right_row_pos").where("left_cluster_id <> right_cluster_id")
    best = Window.partitionBy("right_row_pos").orderBy(F.col("similarity").desc(), F.col("left_row_pos").asc())
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select(F.col("right_row_pos").alias("row_pos"), F.col("left_row_pos").alias("previous"), "similarity", "n")
