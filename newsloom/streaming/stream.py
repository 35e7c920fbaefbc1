"""Structured Streaming around the incremental step: at-least-once batches, keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.components import materialise
from newsloom.operators.ledger import upserted
from newsloom.sources.keyed import KeyedTable

from . import incremental as I


class StateTable:
    """A table kept as one folder for each batch; a batch that is run again writes its own folder again.

    A folder counts once Spark's committer has marked it as complete. A new object on an
    existing path goes on from the last complete one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def at(self, n: int) -> str:
        return f"{self.path}/v={n}"

    def versions(self) -> list[int]:
        """The complete versions, in order; read from the folder, on any file system that Spark reaches."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern)
        return sorted(int(str(f.getPath().getParent().getName())[2:]) for f in found or [])

    def read(self, before: int | None = None) -> DataFrame:
        done = [n for n in self.versions() if before is None or n < before]
        return self.spark.read.schema(self.schema).parquet(self.at(done[-1])) if done else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.at(batch))


STATE_SCHEMA = "news_id string, topic string, published_at timestamp, title string, text string, embedding array<double>, cluster_id string, component_id string, assignment_method string, assignment_parent_news_id string, assignment_similarity double, attached_to_component_id string"


def assign(articles: DataFrame, state: StateTable | KeyedTable, checkpoint: str, config: I.Config = I.Config(), available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """Run the incremental step for each micro-batch of an article stream; a KeyedTable by news_id rewrites only the buckets of rows that change."""

    def step(batch: DataFrame, n: int) -> None:
        history = state.read(before=n)
        new = batch.dropDuplicates(["news_id"]).join(history.select("news_id"), "news_id", "left_anti")
        changes = I.assigned(history, new, config)
        new = new.withColumn("embedding", F.col("embedding").cast("array<double>"))
        if isinstance(state, KeyedTable):
            changes = materialise(changes)
            state.upsert(I.moved(history, new, changes), n)
        else:
            state.write(I.applied(history, new, changes), n)

    w = articles.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def jobs(messages: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], log: StateTable, checkpoint: str) -> StreamingQuery:
    """Dispatch each micro-batch by message type; a failing or unknown type is marked and the rest goes on. ``queue.JobQueue`` also retries."""

    def step(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        lost = batch.where(~F.coalesce(F.col("type").isin(*handlers), F.lit(False)))
        marks = lost.select("job_id", "type", F.lit("unknown").alias("status"), F.lit("no handler").alias("error"))
        for kind, handle in handlers.items():
            own = batch.where(F.col("type") == kind)
            try:
                handle(own, n)
                status, error = "done", None
            except Exception as e:  # noqa: BLE001  a failed job is recorded, and the queue goes on
                status, error = "failed", str(e)[:500]
            mark = own.select("job_id", F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
            marks = marks.unionByName(mark)
        log.write(upserted(log.read(before=n), marks.dropDuplicates(["job_id"]), ["job_id"]), n)
        batch.unpersist()

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


JOBS_SCHEMA = "job_id string, type string, status string, error string"


def event_counts(events: DataFrame, late: str = "14 days", width: str = "1 hour") -> DataFrame:
    """Windowed counts and sums by type; the watermark only bounds the state kept for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
