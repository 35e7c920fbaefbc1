"""Top-k vector search with one entry for each story, and its feed."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import vector as V

from .components import materialise, ranked


def visible(organization: str | None = None, language: str | None = None, source: str | None = None, published_from: str | None = None, published_to: str | None = None, min_novelty: float | None = None) -> Column:
    """The conjunction of the filters that are given; both ends of the period are included."""
    tests = [F.col("status") == "processed", F.col("visibility") == "public"]
    tests += [F.col(c) == v for c, v in (("organization_id", organization), ("language", language), ("source_id", source)) if v]
    if published_from:
        tests.append(F.col("published_at") >= F.lit(published_from).cast("timestamp"))
    if published_to:
        tests.append(F.col("published_at") <= F.lit(published_to).cast("timestamp"))
    if min_novelty is not None:
        tests.append(F.col("novelty_score") >= min_novelty)
    return reduce(lambda a, b: a & b, tests)


def candidate_limit(k: int) -> int:
    return min(max(10 * k, 100), 1000)


def candidate_limits(k: Column) -> Column:
    """candidate_limit of a column."""
    return F.least(F.greatest(10 * k, F.lit(100)), F.lit(1000)).cast("long")


def nearest(articles: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The first candidate_limit(k) rows by cosine with score and 1-based rank; rank is given before any relevance cut."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = (articles.where(where) if where is not None else articles).withColumn("score", V.cosine(V.doubles(F.col("embedding")), q))
    top = found.orderBy(F.col("score").desc(), F.col("news_id").asc()).limit(candidate_limit(k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("news_id").asc())))


QUERIES = 4096  # that a task compares its rows with at once


def _block(asked: list, corpus: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, news_id, score): of each task's rows the best k for each of at most QUERIES queries."""
    ids, q = [r.query_id for r in asked], np.array([r.query for r in asked], float)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(ids) else q

    def best(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (names, scores) of each query so far

        def top(name: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((name, -np.round(s, 9)))[:k]
            return name[order], s[order]

        for pdf in batches:
            if not len(pdf) or not ids:
                continue
            x = np.array(pdf["embedding"].tolist(), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            s, name = q @ x.T, pdf["news_id"].to_numpy().astype(str)
            found = []
            for row in s:
                cut = np.round(row, 9)
                some = np.flatnonzero(cut >= np.partition(cut, -k)[-k]) if len(row) > k else np.arange(len(row))
                found.append((name[some], row[some]))
            held = [top(*(np.concatenate(p) for p in zip(a, b, strict=True))) for a, b in zip(held, found, strict=True)] if held else [top(*f) for f in found]
        if held:
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(n) for n, _ in held]), "news_id": np.concatenate([n for n, _ in held]), "score": np.concatenate([s for _, s in held])})

    return corpus.select("news_id", V.doubles(F.col("embedding")).alias("embedding")).mapInPandas(best, f"query_id {kind}, news_id string, score double")


def nearest_of_many(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, news_id, score, rank) for a stated set of queries (query_id, query) against all rows.

    Queries are taken in blocks of QUERIES, so what reaches the driver and each task is
    bounded. Each task keeps the best k of its rows for each query of a block before
    anything is shuffled; rows with equal scores go by news_id, in a task as in the result.
    """
    own, kind = queries.select("query_id", V.doubles(F.col("query")).alias("query")), dict(queries.dtypes)["query_id"]
    n = own.count()
    if n <= QUERIES:
        found = _block(own.collect(), corpus, k, kind)
    else:
        placed, found = materialise(ranked(own, F.col("query_id"), name="place")), None
        for at in range(0, n, QUERIES):
            asked = placed.where((F.col("place") >= at) & (F.col("place") < at + QUERIES)).collect()
            part = materialise(_block(asked, corpus, k, kind))
            found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("news_id").asc()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def grouped(items: DataFrame, k: int | None = None) -> DataFrame:
    """Clusters of ranked items in the order of their best rank; representative, size and period from the summary if there is one."""
    first = F.min_by(F.struct("news_id", "title", "representative_article_id", "representative_title", "article_count", "started_at", "last_seen_at"), "rank")
    by_date = F.array_sort(F.collect_list(F.struct(F.col("published_at"), F.col("rank"), F.col("news_id"))))
    out = items.groupBy("cluster_id").agg(F.min("rank").alias("best_rank"), first.alias("f"), F.count("*").alias("n"), F.count_if(F.col("novelty_label") == "significant").alias("significant_count"), F.max("score").alias("score"), F.min("published_at").alias("lo"), F.max("published_at").alias("hi"), by_date.alias("items"))
    out = out.select(
        "cluster_id", "best_rank", "score", "significant_count", F.coalesce("f.representative_article_id", "f.news_id").alias("representative_article_id"), F.coalesce("f.representative_title", "f.title").alias("representative_title"),
        F.coalesce("f.article_count", "n").cast("long").alias("article_count"), F.coalesce("f.started_at", "lo").alias("published_from"), F.coalesce("f.last_seen_at", "hi").alias("published_to"), F.transform("items", lambda s: s["news_id"]).alias("items"),
    )
    return out.orderBy("best_rank").limit(k) if k else out


def search(articles: DataFrame, summaries: DataFrame, query: list[float], k: int = 10, where: Column | None = None, min_relevance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(clusters, items): the k best stories, expanded to all their processed and public members."""
    rich = articles.withColumn("cluster_id", F.coalesce("cluster_id", "news_id")).join(summaries, ["organization_id", "cluster_id"], "left")
    return _search(rich, query, k, visible() if where is None else where, min_relevance)


def _search(rich: DataFrame, query: list[float], k: int, where: Column, min_relevance: float) -> tuple[DataFrame, DataFrame]:
    matched = nearest(rich, query, k, where).where(F.col("score") >= min_relevance)
    best = grouped(matched, k).select("cluster_id", F.col("best_rank").alias("cluster_order"), F.col("score").alias("cluster_score"))
    members = rich.where(visible()).join(best, "cluster_id").join(matched.select("news_id", "score"), "news_id", "left")
    # Ranks go story by story: a story's first rank is what the stories before it hold, of which there are k at most.
    members = materialise(members)
    before = F.sum("n").over(Window.orderBy("cluster_order")) - F.col("n")
    starts = members.groupBy("cluster_order").agg(F.count("*").alias("n")).select("cluster_order", before.alias("_before"))
    own = Window.partitionBy("cluster_order").orderBy("published_at", "news_id")
    items = members.join(F.broadcast(starts), "cluster_order").withColumn("rank", (F.col("_before") + F.row_number().over(own)).cast("int")).drop("_before")
    clusters = grouped(items).drop("score").join(best.select("cluster_id", F.col("cluster_score").alias("score")), "cluster_id")
    return clusters, items


def collapsed(ranked: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, cluster_id, rank): the first of each cluster, the best k of each query, ranked anew."""
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "cluster_id").orderBy("rank"))).where("n = 1").drop("n")
    return first.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("new_rank") <= k)


def shown(items: Column) -> Column:
    """The first three that are no duplicates, of an array of structs with a field label."""
    return F.slice(F.filter(items, lambda x: x["label"] != "duplicate"), 1, 3)


def feed(articles: DataFrame, start: str, end: str, organization: str | None = None) -> DataFrame:
    """Processed public articles with start <= published_at < end."""
    return articles.where(visible(organization) & (F.col("published_at") >= F.lit(start).cast("timestamp")) & (F.col("published_at") < F.lit(end).cast("timestamp")))


def page(clusters: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """Places offset + 1 to offset + limit; only so many rows of each task are looked at."""
    first = clusters.orderBy(*order).limit(offset + limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)


def adjacent_dates(articles: DataFrame, start: str, end: str) -> DataFrame:
    """(previous, next): the closest instants outside [start, end), in one pass."""
    ts, a, b = F.col("published_at"), F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return articles.agg(F.max(F.when(ts < a, ts)).alias("previous"), F.min(F.when(ts >= b, ts)).alias("next"))


def stored(articles: DataFrame, summaries: DataFrame, path: str) -> DataFrame:
    """Articles with their story and its summary, written once for many searches: by language, so that a filter reads its own part."""
    rich = articles.withColumn("cluster_id", F.coalesce("cluster_id", "news_id")).join(summaries, ["organization_id", "cluster_id"], "left")
    rich.repartition("language", "cluster_id").sortWithinPartitions("language", "cluster_id").write.mode("overwrite").partitionBy("language").parquet(path)
    return articles.sparkSession.read.schema(rich.schema).parquet(path)


def search_stored(rich: DataFrame, query: list[float], k: int = 10, where: Column | None = None, min_relevance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``search`` over the table that ``stored`` has written."""
    return _search(rich, query, k, visible() if where is None else where, min_relevance)
