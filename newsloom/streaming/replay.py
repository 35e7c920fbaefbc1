"""Replay: the incremental step over past weeks, compared with a full run at each checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import attach as A
from newsloom.operators import metrics as M
from newsloom.operators import pairs as P
from newsloom.operators.components import materialise

from . import incremental as I
from . import keyed


def full(news: DataFrame, c: I.Config) -> DataFrame:
    """(row_pos, news_id, cluster) of the batch pipeline."""
    base = materialise(A.baseline(news, c.strong, c.days))
    chosen = A.selection(P.candidate_pairs(news, c.attach, min(c.days, c.attach_days), A.sources(base)), base, c.attach, c.attach_days, 2, c.title_jaccard, c.shared_numbers, c.margin)
    return A.attached(base, chosen).select("row_pos", "news_id", "cluster", "baseline_component")


def replay(news: DataFrame, c: I.Config, steps: int | None = None) -> list[tuple]:
    """[(from, to, rows, metrics row)]: accumulated increments against a full run of all rows so far."""
    lo, hi = news.agg(F.min("published_at"), F.max("published_at")).first()
    out, state = [], None
    for n, (a, b) in enumerate(I.checkpoints(lo, hi)):
        if steps is not None and n > steps:
            break
        new = news.where((F.col("published_at") >= F.lit(a)) & (F.col("published_at") < F.lit(b)))
        if state is None:
            text = lambda x: F.concat(F.lit("full_"), F.col(x).cast("string"))
            first = full(new, c).select("news_id", text("cluster").alias("cluster_id"), text("baseline_component").alias("component_id"))
            state = materialise(new.join(first, "news_id").withColumns({"assignment_method": F.lit("baseline"), "assignment_parent_news_id": F.lit(None).cast("string"), "assignment_similarity": F.lit(None).cast("double"), "attached_to_component_id": F.lit(None).cast("string"), "embedding": F.col("embedding").cast("array<double>")}).select(*I.STATE))
            continue
        if not new.limit(1).count():
            continue
        changes = materialise(I.assigned(state, new, c))
        state = materialise(I.applied(state, new.withColumn("embedding", F.col("embedding").cast("array<double>")), changes))
        so_far = news.where(F.col("published_at") < F.lit(b))
        both = full(so_far, c).join(state.select("news_id", "cluster_id"), "news_id")
        out.append((a, b, both.count(), M.pairwise(both, "cluster", "cluster_id").first()))
    return out


def by_stream(news: DataFrame, c: I.Config, folder: str, step_days: int = 7, bootstrap_days: int = 14) -> DataFrame:
    """(upto, rows, clusters, precision, recall, f1): the keyed stream against a full run, at each checkpoint.

    Each step's rows are written as one more file of the source, and the stream is started
    anew from its checkpoint to read what is there; a step that was read stays read.
    """
    spark = news.sparkSession
    lo, hi = news.agg(F.min("published_at"), F.max("published_at")).first()
    rows = []
    for a, b in I.checkpoints(lo, hi, bootstrap_days, step_days) if lo is not None else ():
        step = news.where((F.col("published_at") >= F.lit(a)) & (F.col("published_at") < F.lit(b)))
        step.write.mode("append").parquet(f"{folder}/in")
        articles = spark.readStream.schema(news.schema).parquet(f"{folder}/in")
        keyed.started(articles, f"{folder}/out", f"{folder}/checkpoint", c).awaitTermination()
        now = keyed.current(spark.read.parquet(f"{folder}/out")).select("news_id", "cluster_id")
        both = materialise(full(news.where(F.col("published_at") < F.lit(b)), c).join(now, "news_id"))
        m = M.pairwise(both, "cluster", "cluster_id").first()
        n, clusters = both.agg(F.count("*"), F.countDistinct("cluster_id")).first()
        rows.append((b.to_pydatetime(), n, clusters, m.precision, m.recall, m.f1))
    return spark.createDataFrame(rows, "upto timestamp, rows long, clusters long, precision double, recall double, f1 double")
