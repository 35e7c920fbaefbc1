"""Job metrics as tables: finished jobs and observed stream counts are appended, counters and the like are computed.

A ``Meter`` is told each finished job and listens to the progress of streams, whose counts
come from ``DataFrame.observe``. It holds at most HELD rows and appends them as Parquet, so
metrics survive the driver. The functions below turn those rows into what a dashboard
shows: counters, gauges of the latest job, and cumulative duration buckets.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from time import monotonic

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

HELD = 1000
#: Upper bounds of the duration buckets, in seconds.
BUCKETS = (1, 5, 10, 30, 60, 120, 300, 600, 1200, 1800, 3600)
JOBS = "at timestamp, mode string, status string, rows long, seconds double"
OBSERVED = "at timestamp, query string, batch long, name string, metric string, value double, seconds double"


class Meter(StreamingQueryListener):
    """Use it as a context, which adds and removes the listener and writes what is left."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._rows: dict[str, list[tuple]] = {"jobs": [], "observed": []}
        self._lock = threading.Lock()

    def __enter__(self) -> Meter:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # progress is told behind the query's end
        self.spark.streams.removeListener(self)
        self.flush()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        with self._lock:
            for name, row in p.observedMetrics.items():
                self._rows["observed"] += [(at, p.name, p.batchId, name, k, float(v), seconds) for k, v in row.asDict().items()]

    def job(self, mode: str, status: str, rows: int, seconds: float) -> None:
        with self._lock:
            self._rows["jobs"].append((dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), mode, status, rows, seconds))
        if len(self._rows["jobs"]) >= HELD:
            self.flush()

    def timed(self, mode: str, rows: DataFrame, run: Callable[[DataFrame], object]) -> object:
        """Run a batch job over rows, which are counted as they pass, and record it, failed or done. The job must read the rows: their count is waited for."""
        seen, began, status = Observation(), monotonic(), "failed"
        try:
            out = run(rows.observe(seen, F.count("*").alias("rows")))
            status = "done"
            return out
        finally:
            self.job(mode, status, seen.get["rows"] if status == "done" else 0, monotonic() - began)

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, {"jobs": [], "observed": []}
        for name, schema in (("jobs", JOBS), ("observed", OBSERVED)):
            if rows[name]:
                self.spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(top)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def jobs(self) -> DataFrame:
        return self._table("jobs", JOBS)

    def observed(self) -> DataFrame:
        return self._table("observed", OBSERVED)


def counters(jobs: DataFrame) -> DataFrame:
    """(mode, status, jobs, articles): finished jobs, and the rows of those that are done."""
    return jobs.groupBy("mode", "status").agg(F.count("*").alias("jobs"), F.sum(F.when(F.col("status") == "done", F.col("rows")).otherwise(0)).alias("articles"))


def gauges(jobs: DataFrame) -> DataFrame:
    """(mode, last_status, last_seconds, throughput): the latest job of each mode, and the rows a second of its latest done one."""
    done = F.when(F.col("status") == "done", F.struct("at", (F.col("rows") / F.greatest("seconds", F.lit(1e-9))).alias("x")))
    return jobs.groupBy("mode").agg(F.max_by("status", "at").alias("last_status"), F.max_by("seconds", "at").alias("last_seconds"), F.max(done).alias("d")).select("mode", "last_status", "last_seconds", F.col("d.x").alias("throughput"))


def buckets(jobs: DataFrame) -> DataFrame:
    """(mode, le, n): jobs that took at most le seconds; infinity counts all."""
    each = [F.struct(F.lit(float(x)).alias("le"), F.count_if(F.col("seconds") <= x).alias("n")) for x in (*BUCKETS, float("inf"))]
    return jobs.groupBy("mode").agg(F.array(*each).alias("b")).select("mode", F.explode("b").alias("b")).select("mode", "b.le", "b.n")
