"""Normalisation contracts of article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

REQUIRED = ("news_id", "published_at", "title", "text")


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def prepared(df: DataFrame) -> DataFrame:
    """The strict contract: ids normalised, dates parsed or an error, nulls in texts empty, topic filled, model_text built."""
    require(df)
    ts = F.try_to_timestamp(F.col("published_at").cast("string"))
    out = df.withColumn("news_id", T.news_id(F.col("news_id")))
    out = out.withColumn("published_at", F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.lit("a row has no valid date")).cast("timestamp")))
    for c in ("title", "text"):
        out = out.withColumn(c, T.safe_text(F.col(c)))
    topic = F.col("topic").cast("string") if "topic" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("topic", F.coalesce(topic, F.lit("<missing>")))
    built = F.concat(F.col("title"), F.lit("\n\n"), F.col("text"))
    return out.withColumn("model_text", F.coalesce(F.col("model_text"), built) if "model_text" in df.columns else built)


def light(df: DataFrame) -> DataFrame:
    """The light contract: ids trimmed, unreadable dates null, null texts empty, title and text joined by one line break and trimmed."""
    require(df)
    out = df.withColumns({"news_id": T.news_id(F.col("news_id")), "published_at": F.try_to_timestamp(F.col("published_at").cast("string")), "title": T.safe_text(F.col("title")), "text": T.safe_text(F.col("text"))})
    return out.withColumn("model_text", F.regexp_replace(F.concat("title", F.lit("\n"), "text"), r"^\s+|\s+$", ""))


def clean_like(df: DataFrame) -> DataFrame:
    """The lenient contract: rows without a date go, ids are made where absent, lengths and word counts added."""
    ts = F.try_to_timestamp(F.col("published_at").cast("string"))
    out = df.withColumn("published_at", ts).where(F.col("published_at").isNotNull())
    url = F.col("url") if "url" in df.columns else F.lit(None).cast("string")
    made = T.stable_id(url, F.col("title"), F.date_format("published_at", "yyyy-MM-dd"))
    out = out.withColumn("news_id", F.coalesce(T.news_id(F.col("news_id")), made))
    topic = F.col("topic").cast("string") if "topic" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("topic", F.coalesce(topic, F.lit("<missing>")))
    for c in ("title", "text"):
        out = out.withColumn(c, T.safe_text(F.col(c)))
    out = out.withColumn("model_text", F.concat("title", F.lit("\n\n"), "text"))
    for c, name in (("text", "text"), ("title", "title"), ("model_text", "model")):
        out = out.withColumn(f"{name}_length", F.length(c).cast("long")).withColumn(f"{name}_num_words", T.word_count(F.col(c)))
    return out


def restored(pool: DataFrame, clean: DataFrame) -> DataFrame:
    """A candidate pool with each missing value taken from the clean table."""
    shared = [c for c in clean.columns if c != "news_id" and c in pool.columns]
    extra = [c for c in clean.columns if c != "news_id" and c not in pool.columns]
    c = clean.select("news_id", *[F.col(x).alias(f"_{x}") for x in shared], *extra)
    rest = [x for x in pool.columns if x not in shared and x != "news_id"]
    return pool.join(c, "news_id", "left").select("news_id", *rest, *[F.coalesce(x, f"_{x}").alias(x) for x in shared], *extra)


def deduplicated(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def cleaned(df: DataFrame, min_words: int = 20) -> DataFrame:
    """Rows with a date, a title and enough words; of equal texts, then of equal urls, the earliest."""
    ok = df.where(F.col("published_at").isNotNull() & (F.trim(T.safe_text(F.col("title"))) != "") & (T.space_word_count(F.col("text")) >= min_words))
    order = [F.col("published_at").asc(), F.col("news_id").asc()]
    by_text = deduplicated(ok.withColumn("_h", F.sha2("text", 256)), ["_h"], *order).drop("_h")
    return deduplicated(by_text, ["url"], *order) if "url" in df.columns else by_text


def import_row(df: DataFrame) -> DataFrame:
    """An import file's columns: trimmed, empty as null, dates to UTC, language ru by default."""
    def opt(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")

    date = F.regexp_replace(F.coalesce(opt("published_at"), opt("date")), "/", "-")
    rest = F.map_filter(F.create_map(F.lit("tags"), opt("tags")), lambda k, v: v.isNotNull())
    return df.select(opt("title").alias("title"), F.coalesce(opt("content"), opt("text")).alias("content"), F.try_to_timestamp(date).alias("published_at"), opt("url").alias("url"), opt("topic").alias("topic"), F.coalesce(opt("language"), F.lit("ru")).alias("language"), F.coalesce(opt("external_id"), opt("news_id")).alias("external_id"), F.to_json(rest).alias("metadata"))


STATUS = {"new": "not_started", "queued": "pending", "in_progress": "processing", "done": "processed", "failed": "error"}


def status_remapped(x: Column) -> Column:
    """Old status names to new ones."""
    out = None
    for old, new in STATUS.items():
        out = F.when(x == old, new) if out is None else out.when(x == old, new)
    return out.otherwise(x)
