"""A queue of jobs in a folder: at-least-once, with retries, a dead-letter table and a log of attempts.

Messages are JSON files below ``in``; the file source keeps its place in its checkpoint,
and a micro-batch is taken off the queue only once it has been handled and logged. The
messages of a type whose handler fails are put back with one more attempt, in a file of
that batch, so they come again after all that wait now; after ``attempts`` failures, or if
their type has no handler, they go to ``dead``. All that a batch writes is written in a
folder of its own number, so a batch that is run again after a crash replaces what it had
written. Log and dead letters only grow; ``status`` takes each job's latest attempt.

Messages without a type count as unknown; a message that can't be read as JSON is unknown too.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .metrics import Meter

MESSAGE = "type string, job_id string, news_ids array<string>, mode string, organization_id string, attempt int"
LOG = "job_id string, type string, attempt int, status string, error string, batch long"
DEAD = MESSAGE + ", error string, batch long"


class JobQueue:
    """``handlers``: what to do with the messages of a type, (rows, batch number) to nothing; an exception is a failure of all of them."""

    def __init__(self, spark: SparkSession, folder: str, handlers: dict[str, Callable[[DataFrame, int], None]], attempts: int = 3, files: int = 100, meter: Meter | None = None):
        self.spark, self.folder, self.handlers = spark, folder.rstrip("/"), handlers
        self.attempts, self.files, self.meter = attempts, files, meter

    def publish(self, messages: DataFrame) -> None:
        messages.write.mode("append").json(f"{self.folder}/in")

    def _step(self, batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("attempt", F.coalesce("attempt", F.lit(0))).persist()
        known, marks, bad = F.col("type").isin(*self.handlers), [], []
        mark = lambda rows, status, error: rows.select("job_id", "type", "attempt", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))
        for kind, handle in self.handlers.items():
            own = batch.where(F.col("type") == kind)
            rows, began = own.count(), time.monotonic()
            if not rows:
                continue
            try:
                handle(own, n)
                status, error = "done", None
            except Exception as e:  # noqa: BLE001  a failed job is recorded and comes again, and the queue goes on
                status, error = "failed", str(e)[:500]
                bad.append((kind, error))
            marks.append(mark(own, status, error))
            if self.meter:
                self.meter.job(kind, status, rows, time.monotonic() - began)
        lost = batch.where(~F.coalesce(known, F.lit(False)))
        marks.append(mark(lost, "unknown", "no handler"))
        log = marks[0]
        for m in marks[1:]:
            log = log.unionByName(m)
        log.write.mode("overwrite").parquet(f"{self.folder}/log/batch={n}")
        dead = lost.withColumn("error", F.lit("no handler"))
        for kind, error in bad:
            failed = batch.where(F.col("type") == kind)
            dead = dead.unionByName(failed.where(F.col("attempt") + 1 >= self.attempts).withColumn("error", F.lit(error)))
        dead.write.mode("overwrite").parquet(f"{self.folder}/dead/batch={n}")
        if bad:
            again = batch.where(F.col("type").isin(*[k for k, _ in bad]) & (F.col("attempt") + 1 < self.attempts))
            again.withColumn("attempt", F.col("attempt") + 1).write.mode("overwrite").json(f"{self.folder}/in/again-{n}")
        batch.unpersist()

    def start(self, available_now: bool = True) -> StreamingQuery:
        rows = self.spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", self.files).option("recursiveFileLookup", "true").json(f"{self.folder}/in")
        if self.handlers:
            counts = [F.count_if(F.col("type") == k).alias(k) for k in self.handlers]
            rows = rows.observe("messages", F.count("*").alias("all"), *counts)
        w = rows.writeStream.queryName(f"jobs-{self.folder.rsplit('/', 1)[-1]}").foreachBatch(self._step).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()

    def drain(self) -> None:
        """Handle all that waits, and what comes again of it."""
        for _ in range(self.attempts):
            self.start().awaitTermination()

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not top.getFileSystem(conf).exists(top):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def dead(self) -> DataFrame:
        return self._table("dead", DEAD)

    def status(self) -> DataFrame:
        """(job_id, type, status, error, attempts): each job after its latest attempt."""
        last = F.max_by(F.struct("type", "status", "error", "attempt"), F.struct("attempt", "batch"))
        return self.log().groupBy("job_id").agg(last.alias("x")).select("job_id", "x.type", "x.status", "x.error", (F.col("x.attempt") + 1).alias("attempts"))
