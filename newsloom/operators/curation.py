"""Annotation files, raw article files, label overrides, validated joins and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

PREDICTION = {"news_id": "string", "published_at": "timestamp", "topic": "string", "title": "string", "text": "string", "cluster_id": "string", "novelty_label": "string", "comment": "string", "needs_review": "boolean"}
ALIASES = {"left": ("text_1", "text1", "sentence1", "question1"), "right": ("text_2", "text2", "sentence2", "question2"), "label": ("label", "class", "is_duplicate")}


def with_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a schema in order; missing ones are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in schema.items()])


def detected(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str]:
    """Which column stands for each role, by name; an error if none does."""
    lower = {c.lower(): c for c in df.columns}
    out = {role: next((lower[n] for n in names if n in lower), None) for role, names in aliases.items()}
    if missing := [r for r, c in out.items() if c is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return out


def raw_normalised(df: DataFrame) -> DataFrame:
    """A raw file's columns: date to timestamp, unknown topics and tags named, model text and lengths."""
    fill = lambda c, x: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(x))
    out = df.withColumn("published_at", F.try_to_timestamp(F.regexp_replace("date", "/", "-"))).drop("date")
    out = out.withColumns({"topic": fill("topic", "unknown"), "tags": fill("tags", "unknown"), "title": T.safe_text(F.col("title")), "text": T.safe_text(F.col("text"))})
    out = out.withColumn("model_text", F.concat("title", F.lit(". "), "text"))
    return out.withColumns({"text_length": F.length("text").cast("long"), "title_length": F.length("title").cast("long"), "text_num_words": T.space_word_count(F.col("text"))})


def source_rows(df: DataFrame) -> DataFrame:
    """Rows of a source file: lines without trailing blanks, topic from tags where absent, id from the url."""
    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.select(F.substring(F.sha2("url", 256), 1, 24).alias("news_id"), "url", T.clean_lines(F.col("title")).alias("title"), T.clean_lines(F.col("text")).alias("text"), F.coalesce(has("topic"), has("tags"), F.lit("unknown")).alias("topic"))


def annotated(annotation: DataFrame, clean: DataFrame) -> DataFrame:
    """Annotation rows with missing texts from the clean table, and lengths and word counts made anew."""
    shared = ["title", "text", "topic"]
    c = clean.select("news_id", *[F.col(x).alias(f"_{x}") for x in shared])
    out = annotation.join(c, "news_id", "left").withColumns({x: F.coalesce(x, f"_{x}") for x in shared}).drop(*[f"_{x}" for x in shared])
    return out.withColumns({"text_length": F.length("text").cast("long"), "text_num_words": T.space_word_count(F.col("text"))})


def confusion_cell(truth: Column, guess: Column) -> Column:
    return F.when((truth == 1) & (guess == 1), "TP").when((truth == 0) & (guess == 0), "TN").when((truth == 0) & (guess == 1), "FP").when((truth == 1) & (guess == 0), "FN")


def overridden(state: DataFrame, labels: DataFrame, actor: str, at: Column) -> DataFrame:
    """State with manual labels set, or cleared by a null; labels is (news_id, label)."""
    x = state.join(labels.select("news_id", F.col("label").alias("_label"), F.lit(True).alias("_set")), "news_id", "left")
    new = {"manual_novelty_label": F.col("_label"), "manual_novelty_actor_id": F.when(F.col("_label").isNotNull(), actor), "manual_novelty_updated_at": at}
    return x.select(*[F.when(F.col("_set"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns])


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that fails where a key repeats on either side."""
    def once(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(df.schema[key].dataType)))

    return once(left).join(once(right), key)


def complete(rows: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """rows with a saved value each; an error if one has none."""
    x = rows.join(saved.select(key, value), key, "left")
    return x.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("nothing saved for "), F.col(key).cast("string"))).cast(saved.schema[value].dataType)))


def in_order_of(reference: DataFrame, rows: DataFrame, key: str, place: str) -> DataFrame:
    """rows by the reference's places; ids that are absent stay as nulls."""
    return reference.select(key, place).join(rows, key, "left")


def first_crossing(rows: DataFrame, value: str, order: str, threshold: float) -> DataFrame:
    """The first row in order whose value is under the threshold."""
    return rows.where(F.col(value) < threshold).agg(F.min(order).alias("first"), F.min_by(value, order).alias("value"))


def latest_job(jobs: DataFrame, fields: dict[str, str], status: str | None = None) -> DataFrame:
    """The newest job whose JSON request has these fields."""
    x = jobs if status is None else jobs.where(F.col("status") == status)
    for k, v in fields.items():
        x = x.where(F.get_json_object("request", f"$.{k}") == v)
    return x.orderBy(F.col("created_at").desc(), F.col("id")).limit(1)


def throughput(jobs: DataFrame) -> DataFrame:
    """(id, rows per second) of finished jobs."""
    s = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1e6
    return jobs.select("id", F.when(s > 0, F.col("rows") / s).alias("rows_per_second"))


def backfilled(label: Column, manual: Column, probability: Column) -> Column:
    """A label from the manual one, else the model's, else from the probability."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(blank(manual), blank(label), F.when(probability >= 0.42, "significant").when(probability.isNotNull(), "minor"))


def matching_users(users: DataFrame, part: str = "", role: str | None = None) -> DataFrame:
    x = users.where(F.lower("login").contains(part.lower()))
    return x if role is None else x.where(F.col("role") == role)
