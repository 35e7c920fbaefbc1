"""Training frames, experiment tables and models of pyspark.ml over the features."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger as L
from . import metrics as M


def assembled(features: DataFrame, labels: DataFrame, held_out: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(training rows, report): features (row_pos, cluster) joined with labels (row_pos, cluster, label), without held-out rows.

    The report has the number of labels, the share that features cover, the share of rows
    whose label names the same cluster, and a warning if coverage is under ``least``.
    """
    own = labels.select("row_pos", F.col("cluster").alias("label_cluster"), "label")
    x = features.join(own, "row_pos")
    n = own.agg(F.count("*").alias("labels"))
    report = x.agg(F.count("*").alias("rows"), F.avg((F.col("cluster") == F.col("label_cluster")).cast("double")).alias("cluster_match_rate")).crossJoin(F.broadcast(n))
    report = report.select("labels", "rows", (F.col("rows") / F.col("labels")).alias("coverage"), "cluster_match_rate", (F.col("rows") / F.col("labels") < least).alias("warning"))
    return x.join(held_out.select("row_pos").distinct(), "row_pos", "left_anti"), report


def registered(experiments: DataFrame, new: DataFrame) -> DataFrame:
    """The table of experiments (name, ...) with the rows of new in place of those of equal name."""
    return L.upserted(experiments, new, ["name"])


def compact(experiments: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """Experiments with these metrics, the best by one of them first."""
    return experiments.select("name", *metrics).orderBy(F.col(by).desc_nulls_last(), "name")


def weighted_union(gold: DataFrame, silver: DataFrame, gold_weight: float = 1.0, silver_weight: float = 0.35) -> DataFrame:
    """Rows of two label sources with a weight each; a row that both have is gold."""
    rest = silver.join(gold.select("row_pos"), "row_pos", "left_anti")
    return gold.withColumn("weight", F.lit(gold_weight)).unionByName(rest.withColumn("weight", F.lit(silver_weight)))


def fitted(rows: DataFrame, columns: list[str], kind: str = "logistic", seed: int = 42):
    """A pyspark.ml pipeline model on 0/1 ``target`` with ``weight``; kind is logistic or trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = dict(featuresCol="vector", labelCol="target", weightCol="weight")
    last = LogisticRegression(**own, regParam=0.01) if kind == "logistic" else GBTClassifier(**own, maxIter=10, maxDepth=3, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="vector", handleInvalid="keep"), last]).fit(rows)


def importances(model, columns: list[str], spark) -> DataFrame:
    """(feature, importance) from the most important on: a tree model's own, or the absolute coefficients of a logistic one."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return spark.createDataFrame([(c, float(x)) for c, x in zip(columns, values, strict=True)], "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


@dataclass
class Classifier:
    """A fitted pipeline with the threshold above which a row counts as significant."""

    model: object
    columns: list[str]
    threshold: float

    def predicted(self, rows: DataFrame) -> DataFrame:
        """rows with p_significant and predicted (0 or 1)."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(rows)
        p = vector_to_array("probability")[1]
        return out.select(*rows.columns, p.alias("p_significant"), (p >= self.threshold).cast("int").alias("predicted"))

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(self.columns), float(self.threshold))], "columns string, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(path: str, spark: SparkSession) -> Classifier:
        from pyspark.ml import PipelineModel

        r = spark.read.schema("columns string, threshold double").json(f"{path}/settings").first()
        return Classifier(PipelineModel.load(f"{path}/model"), json.loads(r["columns"]), r["threshold"])


def tuned(rows: DataFrame, columns: list[str], kind: str = "logistic", fold: int = 5, steps: int = 99, seed: int = 42) -> tuple[Classifier, DataFrame]:
    """(classifier, sweep): fitted without one row in ``fold``, its threshold the first of the best F1 on those, then fitted anew on all rows.

    rows: (row_pos, *columns, target, weight); which rows validate is a hash of row_pos. The
    sweep (threshold, precision, recall, f1) is one pass over the validation rows, in steps of 1 / (steps + 1).
    """
    held = F.pmod(F.xxhash64("row_pos"), F.lit(fold)) == 0
    first = Classifier(fitted(rows.where(~held), columns, kind, seed), columns, 0.5)
    seen = first.predicted(rows.where(held)).select("p_significant", "target")
    cuts = [(i + 1) / (steps + 1) for i in range(steps)]
    x = M.sweep(seen, "target", "p_significant", cuts)
    best = x.orderBy(F.col("f1").desc(), "threshold").first()
    return Classifier(fitted(rows, columns, kind, seed), columns, best.threshold), x
