"""An import job: files to articles in stages, with a progress table that a user can follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import ledger as L
from newsloom.operators.components import materialise

from . import readers as R

#: The share of the work that is done when a stage begins.
STAGES = {"reading": 5, "parsing": 25, "matching": 55, "inserting": 85, "finishing": 90, "completed": 100}


def import_job(spark: SparkSession, kind: str, path: str, articles: DataFrame, tell: Callable[[str, int, int], None], max_rows: int = R.MAX_ROWS) -> DataFrame:
    """New article rows of the files below path with ``possible_duplicate_of`` and ``is_duplicate``.

    ``tell`` gets each stage, its percent and the rows so far. A file that can't be used
    raises BadImport, and the last stage that was told says where.
    """
    tell("reading", STAGES["reading"], 0)
    raw = materialise(R.read(spark, kind, path))
    tell("parsing", STAGES["parsing"], raw.count())
    good, _ = R.imported(raw, max_rows)
    good = materialise(good.withColumn("content_hash", T.content_hash(F.col("content"))).withColumn("canonical_url", F.col("url")))
    n = good.count()
    tell("matching", STAGES["matching"], n)
    out = materialise(L.inserted(good, articles))
    tell("inserting", STAGES["inserting"], n)
    tell("finishing", STAGES["finishing"], out.where("is_duplicate").count())
    tell("completed", STAGES["completed"], n)
    return out


def progress(spark: SparkSession, job_id: str, told: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame([(job_id, i, *x) for i, x in enumerate(told)], "job_id string, step int, stage string, percent int, rows long")
