"""Evaluation of clusters, labels and rankings, from contingency tables instead of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def contingency(rows: DataFrame, ref: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(ref).alias("r"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def pairwise(rows: DataFrame, ref: str, pred: str) -> DataFrame:
    """One row: pair counts, precision, recall, F1, false-merge rate, adjusted Rand index, normalised mutual information."""
    c = contingency(rows, ref, pred)
    total = c.agg(F.sum("n").alias("total"), F.sum(_pairs(F.col("n"))).alias("tp"))
    side = lambda k: c.groupBy(k).agg(F.sum("n").alias("m")).crossJoin(F.broadcast(total.select("total"))).agg(F.sum(_pairs(F.col("m"))).alias(f"{k}_pairs"), F.count("*").alias(f"{k}_clusters"), F.sum(-(F.col("m") / F.col("total")) * F.log(F.col("m") / F.col("total"))).alias(f"h_{k}"))
    sizes = c.join(c.groupBy("r").agg(F.sum("n").alias("nr")), "r").join(c.groupBy("p").agg(F.sum("n").alias("np")), "p").crossJoin(F.broadcast(total.select("total")))
    mi = sizes.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nr") * F.col("np")))).alias("mi"))
    x = total.crossJoin(side("r")).crossJoin(side("p")).crossJoin(mi)
    col = F.col
    all_ = _pairs(col("total"))
    expected = F.when(all_ > 0, col("r_pairs") * col("p_pairs") / all_).otherwise(0.0)
    most = (col("r_pairs") + col("p_pairs")) / 2
    p, r = ratio(col("tp"), col("p_pairs")), ratio(col("tp"), col("r_pairs"))
    mean_h = (col("h_r") + col("h_p")) / 2
    return x.select(
        "total", col("r_pairs").alias("reference_pairs"), col("p_pairs").alias("predicted_pairs"), col("tp").alias("true_pairs"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(col("p_pairs") - col("tp"), col("p_pairs")).alias("false_merge_rate"),
        F.when(most == expected, 1.0).otherwise((col("tp") - expected) / (most - expected)).alias("adjusted_rand_index"), F.when(mean_h == 0, 1.0).otherwise(col("mi") / mean_h).alias("normalized_mutual_info"), col("r_clusters").alias("reference_clusters"), col("p_clusters").alias("predicted_clusters"),
    )


def structure(rows: DataFrame, ref: str, pred: str) -> DataFrame:
    """Fragmentation and false merges among clusters of more than one row."""
    c = contingency(rows, ref, pred)
    side = lambda k, o, name: c.groupBy(k).agg(F.sum("n").alias("size"), F.count("*").alias("spans")).agg(F.count_if(F.col("size") > 1).alias(f"multi_{name}"), F.count_if((F.col("size") > 1) & (F.col("spans") > 1)).alias(f"split_{name}"), F.sum(F.col("spans") - 1).alias(f"excess_{name}"))
    x = side("r", "p", "full").crossJoin(side("p", "r", "incremental"))
    return x.select("*", ratio(F.col("split_full"), F.col("multi_full")).alias("fragmented_rate"), ratio(F.col("split_incremental"), F.col("multi_incremental")).alias("false_merged_rate"))


def binary(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row of counts and rates for 0/1 columns; rows with a null are left out."""
    x = rows.select(truth.alias("t"), guess.alias("g")).where("t IS NOT NULL AND g IS NOT NULL")
    n = lambda t, g: F.count_if((F.col("t") == t) & (F.col("g") == g))
    x = x.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return x.select("*", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))


def multiclass(counts: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 and Cohen's kappa of rows (truth, guess, n)."""
    side = lambda k, name: counts.groupBy(F.col(k).alias("label")).agg(F.sum("n").alias(name))
    hit = counts.where("truth = guess").groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("hit"))
    by = side("truth", "t").join(side("guess", "g"), "label", "full_outer").join(hit, "label", "left").na.fill(0, ["t", "g", "hit"])
    by = by.withColumn("f1", f1(ratio(F.col("hit"), F.col("g")), ratio(F.col("hit"), F.col("t"))))
    x = by.agg(F.sum("t").alias("total"), F.sum("hit").alias("hit"), F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("t")).alias("wf"), F.sum(F.col("t") * F.col("g")).alias("chance"))
    accuracy, chance = F.col("hit") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return x.select("total", accuracy.alias("accuracy"), "macro_f1", (F.col("wf") / F.col("total")).alias("weighted_f1"), ((accuracy - chance) / (1 - chance)).alias("cohen_kappa"))


def auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """ROC AUC from rank sums with ties at their mean rank, and average precision."""
    from .components import cumulative

    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    by = cumulative(by, {"upto": "n", "pos_upto": "pos"}, F.col("s").asc())
    total = by.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    by = by.crossJoin(F.broadcast(total)).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)
    by = by.withColumn("tp", F.col("all_pos") - F.col("pos_upto") + F.col("pos")).withColumn("seen", F.col("all_n") - F.col("upto") + F.col("n"))
    x = by.agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("ranks"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"))
    return x.select(((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("roc_auc"), (F.col("ap") / F.col("p")).alias("average_precision"))


def sweep(rows: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 for each threshold, in one pass over the rows: each falls in one step of the grid."""
    grid = sorted(thresholds)
    step = sum(((F.col(score) >= t).cast("int") for t in grid[1:]), (F.col(score) >= grid[0]).cast("int"))
    by = rows.groupBy(step.alias("k")).agg(F.sum(truth).alias("pos"), F.count("*").alias("n"))
    spark = rows.sparkSession
    table = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "i int, threshold double")
    total = by.agg(F.sum("pos").alias("all_pos"))
    x = F.broadcast(table).join(by, F.col("k") >= F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("guessed")).crossJoin(F.broadcast(total))
    p, r = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("all_pos"))
    return x.select("threshold", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def retrieval(ranked: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Rows (*by, query_id, rank, relevant, cluster_id): MRR, hit rate, relevant and repeated items within the first k."""
    top = ranked.where(F.col("rank") <= k)
    q = top.groupBy(*by, "query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum("relevant").alias("hits"), F.count("*").alias("n"), F.countDistinct("cluster_id").alias("stories"))
    return q.groupBy(*by).agg(F.count("*").alias("queries"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"), F.avg("hits").alias("relevant"), F.avg(1 - F.col("stories") / F.col("n")).alias("repeat_rate"), F.avg("stories").alias("unique_clusters"))


def transitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, transition, delta, fixed, broken): labels and probabilities of two predictions joined by key.

    ``old`` has the true label as well; fixed rows became right, broken ones wrong.
    """
    x = old.select(key, F.col("label").alias("_a"), F.col("p").alias("_p"), "truth").join(new.select(key, F.col("label").alias("_b"), F.col("p").alias("_q")), key)
    was, now = F.col("_a") == F.col("truth"), F.col("_b") == F.col("truth")
    return x.select(key, F.concat_ws(" -> ", "_a", "_b").alias("transition"), (F.col("_q") - F.col("_p")).alias("delta"), (~was & now).alias("fixed"), (was & ~now).alias("broken"))


def recall_at(ranked: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: the share of queries (query_id, rank, relevant) with a relevant row within each cut, and MRR within the last."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    within = lambda k: F.coalesce(F.col("first") <= k, F.lit(False))
    return first.agg(F.count("*").alias("queries"), *[F.avg(within(k).cast("double")).alias(f"recall_at_{k}") for k in cuts], F.avg(F.when(within(cuts[-1]), 1.0 / F.col("first")).otherwise(0.0)).alias(f"mrr_at_{cuts[-1]}"))


def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two annotation sources (key, label) on their common ids: rows, share of equal labels, Cohen's kappa, macro F1."""
    x = left.select(key, F.col("label").alias("truth")).join(right.select(key, F.col("label").alias("guess")), key)
    return multiclass(x.groupBy("truth", "guess").agg(F.count("*").alias("n"))).select("total", F.col("accuracy").alias("agreement"), "cohen_kappa", "macro_f1")


def grid_search(pairs: DataFrame, rows: DataFrame, reference: str, grid: list[tuple[float, float]]) -> DataFrame:
    """Clusterings of rows (row_pos, reference) for each (days, threshold) over pairs (a, b, similarity, days_diff), compared with the reference.

    Sorted by false-merge rate, then by F1 from the best. The pairs are read once; the grid is a short list.
    """
    from functools import reduce

    from .components import labelled

    parts = []
    for days, threshold in grid:
        found = labelled(rows, pairs.where((F.col("days_diff") <= days) & (F.col("similarity") >= threshold)), "row_pos")
        parts.append(pairwise(found, reference, "component").select(F.lit(float(days)).alias("days"), F.lit(float(threshold)).alias("threshold"), "precision", "recall", "f1", F.col("false_merge_rate")))
    return reduce(DataFrame.unionByName, parts).orderBy("false_merge_rate", F.col("f1").desc(), "days", "threshold")
