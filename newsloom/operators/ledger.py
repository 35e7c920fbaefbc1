"""Ledger, lifecycle and keyed writes, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balances(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("organization_id").agg(F.sum("amount").alias("balance"))


def running(transactions: DataFrame) -> DataFrame:
    """Each transaction with the balance after it; ``allowed`` is false where that is negative."""
    order = Window.partitionBy("organization_id").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    return transactions.withColumn("balance_after", F.sum("amount").over(order)).withColumn("allowed", F.col("balance_after") >= 0)


def valid_amount(x: Column) -> Column:
    """Non-zero whole numbers."""
    return x.isNotNull() & (x != 0) & (x == F.floor(x))


def grouped(transactions: DataFrame) -> DataFrame:
    """One row for each batch, or for each transaction without one."""
    return transactions.groupBy("organization_id", F.coalesce("batch_id", "id").alias("group_id")).agg(F.sum("amount").alias("amount"), F.max("timestamp").alias("timestamp"), F.count("*").alias("items"))


def upserted(state: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """State with the rows of updates in place of those of equal key."""
    return state.join(updates.select(*key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def merged(state: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """State with each column taken from updates where that has a value."""
    u = updates.select(*key, *[F.col(c).alias(f"_{c}") for c in updates.columns if c not in key])
    out = state.join(u, key, "full_outer")
    return out.select(*key, *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in out.columns else F.col(c) for c in state.columns if c not in key])


def changed(requested: DataFrame, articles: DataFrame, allowed: Column, assignments: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(articles after the change, ids that may not change): all of the request or nothing."""
    known = requested.select("news_id").distinct().join(articles.withColumn("_ok", allowed), "news_id", "left")
    bad = known.where(~F.coalesce("_ok", F.lit(False))).select("news_id")
    go = bad.agg((F.count("*") == 0).alias("_go"))
    marked = articles.join(requested.select("news_id").distinct().withColumn("_asked", F.lit(True)), "news_id", "left").crossJoin(F.broadcast(go))
    hit = F.coalesce("_asked", F.lit(False)) & F.col("_go")
    return marked.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in articles.columns]), bad


def may_publish() -> Column:
    return (F.col("visibility") == "draft") & F.col("status").isin("not_started", "error")


def existing(new: DataFrame, articles: DataFrame) -> DataFrame:
    """new with ``possible_duplicate_of``: the article of equal canonical url, else of equal content hash."""
    first = lambda c: articles.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("news_id").alias(f"by_{c}"))
    out = new.join(first("canonical_url"), "canonical_url", "left").join(first("content_hash"), "content_hash", "left")
    return out.withColumn("possible_duplicate_of", F.coalesce("by_canonical_url", "by_content_hash")).drop("by_canonical_url", "by_content_hash")


def unseen(rows: DataFrame, known: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows none of whose keys is known, and of rows that share a key the first in order."""
    out = rows
    for k in keys:
        out = out.join(known.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
        first = F.row_number().over(Window.partitionBy(k).orderBy(order))
        out = out.withColumn("_n", first).where((F.col("_n") == 1) | F.col(k).isNull()).drop("_n")
    return out


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows without those of the ids."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def emptied(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def audited(log: DataFrame, actor: str, action: str, targets: DataFrame, at: Column) -> DataFrame:
    """The audit log with an entry for each target (target_type, target_id, details)."""
    new = targets.select(F.lit(actor).alias("actor_id"), F.lit(action).alias("action"), "target_type", "target_id", "details", at.alias("created_at"))
    return log.unionByName(new)


def by_key(rows: DataFrame, column: str, value) -> DataFrame:
    """At most one row: that of a key, which the scan filters by."""
    return rows.where(F.col(column) == value).limit(1)


def inserted(new: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of an import with ``possible_duplicate_of`` and the flag ``is_duplicate``."""
    return existing(new, articles).withColumn("is_duplicate", F.col("possible_duplicate_of").isNotNull())
