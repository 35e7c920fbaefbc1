"""Novelty labels: by a probability, or by rules on the closest earlier row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

PRIORITY = {"significant": 3, "minor": 2, "duplicate": 1}


def priority(label: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(label == name, p).otherwise(out)
    return out


def logistic(f: DataFrame, weights: dict[str, float], bias: float) -> Column:
    """A fixed logistic scorer, as a stand-in for a trained classifier."""
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + F.col(name) * F.lit(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def labelled(f: DataFrame, p: Column, significant: float = 0.42, duplicate: float = 0.90, review: float = 0.10) -> DataFrame:
    """Labels of feature rows: the first of a cluster is significant; then by probability; then by similarity."""
    seed = F.col("position_in_cluster") == 0
    p = F.when(seed, F.lit(1.0)).otherwise(p)
    label = F.when(seed | (p >= significant), "significant").when(F.col("max_prev_similarity") >= duplicate, "duplicate").otherwise("minor")
    comment = F.when(seed, "cluster seed; significant by definition").otherwise(T.significance_comment(p, F.col("max_prev_similarity")))
    return f.select("row_pos", "cluster", "max_prev_similarity", p.alias("p_significant"), label.alias("novelty_label"), (~seed & (F.abs(p - significant) <= review)).alias("needs_review"), comment.alias("comment"))


def rule_labels(f: DataFrame, minor: float = 0.78, duplicate: float = 0.90, review: float = 0.02) -> DataFrame:
    """Labels from the closest earlier row alone."""
    s, seed = F.col("max_prev_similarity"), F.col("position_in_cluster") == 0
    label = F.when(seed, "significant").when(s >= duplicate, "duplicate").when(s >= minor, "minor").otherwise("significant")
    near = ~seed & ((F.abs(s - duplicate) <= review) | (F.abs(s - minor) <= review))
    return f.select("row_pos", "cluster", label.alias("novelty_label"), F.when(seed, 1.0).otherwise(1 - s).alias("novelty"), near.alias("needs_review"), F.col("best_previous").alias("matched"))


def is_significant(label: Column) -> Column:
    """1 for significant, 0 for minor and duplicate, null for the rest."""
    return F.when(label == "significant", 1).when(label.isin("minor", "duplicate"), 0)


def training_rows(features: DataFrame, labels: DataFrame, held_out: DataFrame) -> DataFrame:
    """Features with a 0/1 target, without held-out ids."""
    return features.join(labels.select("row_pos", is_significant(F.col("label")).alias("target")), "row_pos").where("target IS NOT NULL").join(held_out.select("row_pos"), "row_pos", "left_anti")
