"""A table by key whose writes rewrite only the buckets that they touch.

Rows stand in a folder of their key's bucket, one folder for each version of the bucket. A
write reads the touched buckets, writes their next version, and then a manifest of which
version of each bucket counts. The manifest is one small table that is complete or not
there, so readers see a write whole or not at all, and a write that died or is run again
(under its own number, as by a stream's batch) leaves nothing behind that counts. Buckets
that a write does not touch keep their files.

Updates that repeat a key, or lack a part of it, are an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import ledger as L
from newsloom.operators.components import materialise

MANIFEST = "bucket int, version long"


class KeyedTable:
    """``buckets`` is fixed when the table is made: about as many as hold what one task should rewrite."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/version={version}/bucket={bucket}"

    def versions(self) -> list[int]:
        """Numbers of the complete manifests, in order."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v=*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern)
        return sorted(int(str(f.getPath().getParent().getName())[2:]) for f in found or [])

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows, as of the latest write (before a number); a row for each bucket at most."""
        done = [n for n in self.versions() if before is None or n < before]
        return {r.bucket: r.version for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={done[-1]}").collect()} if done else {}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        found = [self._folder(b, v) for b, v in sorted(self.manifest(before).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, touched: list[int], n: int, before: dict[int, int]) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={n}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        there = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={n}/bucket=*")
        full = {int(str(f.getPath().getName()).split("=")[1]) for f in there.getFileSystem(conf).globStatus(there) or []}
        now = {b: v for b, v in before.items() if b not in touched} | {b: n for b in full}
        self.spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={n}")

    def change(self, updates: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], n: int | None = None) -> None:
        """Write how(rows of the touched buckets, updates) as version n, by default the next."""
        updates = materialise(updates)
        if updates.groupBy(*self.key).count().where("count > 1").limit(1).count() or updates.count() > updates.dropna(subset=self.key).count():
            raise ValueError("updates repeat a key or lack one")
        done = self.versions()
        n = n if n is not None else (done[-1] + 1 if done else 0)
        touched = sorted(r.b for r in updates.select(self._bucket().alias("b")).distinct().collect())  # no more than there are buckets
        before = self.manifest(n)
        rows = materialise(how(self.read(n, touched), updates))  # read whole before a version of the same number is replaced
        self._write(rows, touched, n, before)

    def replace(self, rows: DataFrame, n: int | None = None) -> None:
        """All rows anew."""
        done = self.versions()
        self._write(rows, list(range(self.buckets)), n if n is not None else (done[-1] + 1 if done else 0), {})

    def upsert(self, updates: DataFrame, n: int | None = None) -> None:
        """Rows of updates in place of those of equal key."""
        self.change(updates, lambda old, new: L.upserted(old, new, self.key), n)

    def merge(self, updates: DataFrame, n: int | None = None) -> None:
        """Each column from updates where that has a value."""
        self.change(updates, lambda old, new: L.merged(old, new, self.key), n)

    def delete(self, keys: DataFrame, n: int | None = None) -> None:
        self.change(keys.select(*self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"), n)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` manifests names; how many."""
        done = self.versions()
        named = {(b, v) for n in done[-keep:] for b, v in self.manifest(n + 1).items()}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern, gone = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version=*/bucket=*"), 0
        fs = pattern.getFileSystem(conf)
        for f in fs.globStatus(pattern) or []:
            b, v = int(str(f.getPath().getName()).split("=")[1]), int(str(f.getPath().getParent().getName()).split("=")[1])
            if (b, v) not in named and (not done or v <= done[-1]):
                fs.delete(f.getPath(), True)
                gone += 1
        return gone
