"""Previous-only features of each row within its cluster, in (published_at, row_pos) order.

Vectors cannot be folded in a window frame, so a cluster is cut into a few blocks by
position and bytes, and each pair of blocks is one piece of work: similarities are matrix
products, common tokens are counted by lists of the rows that hold them. What leaves it is
one row of partial results for each row of the later block and piece of the earlier one,
never a row for each pair. The running centroid needs no vectors at
all: with r = sum of similarities to the earlier rows and S = sum over earlier rows of
(1 + 2 r), the similarity to their centroid is r / sqrt(S).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

from . import pairs as P
from . import tiles

COLUMNS = ["position_in_cluster", "cluster_size_so_far", "days_since_previous", "days_since_cluster_start", "max_prev_similarity", "mean_prev_similarity", "min_prev_similarity", "top2_mean_similarity", "top3_mean_similarity", "last_prev_similarity", "previous_centroid_similarity", "previous_centroid_distance", "title_jaccard_max", "text_jaccard_max", "shared_numbers_count", "new_numbers_count", "title_length", "text_length"]


def _top_mean(sims: str, k: int):
    top = F.slice(F.sort_array(F.col(sims), False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)


BLOCK, PIECE = 256, 4096  # rows of the later and of the earlier block that are compared at once
PARTS, LEAST, MOST = 4, 1 << 18, 1 << 26  # blocks of a cluster; bytes of a block
_PARTS = "row_pos long, top double, least double, total double, n long, tops array<double>, last double, last_pos int, best_pos int, best_row long, tj double, xj double"


class _Sets:
    """Sets of token hashes, by token the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        token = np.concatenate([*sets, np.empty(0, np.int64)])
        order = np.argsort(token, kind="stable")
        self.owner, token = np.repeat(np.arange(len(sets)), self.sizes)[order], token[order]
        first = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
        self.token, self.ends = token[first], np.append(first, len(token))

    def jaccards(self, others: list[np.ndarray]) -> np.ndarray:
        """Jaccard similarities, a row for each of others; 0 where both sets are empty."""
        common = np.zeros((len(others), len(self.sizes)))
        for row, x in zip(common, others, strict=True):
            at = np.searchsorted(self.token, x) if len(self.token) else np.empty(0, np.int64)
            at = at[self.token[np.minimum(at, len(self.token) - 1)] == x[: len(at)]]
            if len(at):
                held = np.concatenate([self.owner[a:z] for a, z in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)])
                row[:] = np.bincount(held, minlength=len(row))
        either = np.array([len(x) for x in others])[:, None] + self.sizes[None, :] - common
        return np.where(either > 0, common / np.maximum(either, 1), 0.0)


def _compared(t: pd.DataFrame) -> pd.DataFrame:
    """Partial results of the rows of the later of two blocks (or of one with itself), sorted by position: a row for each piece of the earlier one."""
    later, whole = t[t["blk"] == t["j"].iloc[0]], t[t["blk"] == t["i"].iloc[0]]
    out = []
    for k in range(0, len(whole), PIECE):
        left = whole.iloc[k : k + PIECE]
        pos, row, units = left["pos"].to_numpy(), left["row_pos"].to_numpy(), np.stack(left["unit"].to_numpy())
        sets = {c: _Sets(left[c].tolist()) for c in ("title", "text")}
        after = later[later["pos"] > pos[0]]
        for m in range(0, len(after), BLOCK):
            right = after.iloc[m : m + BLOCK]
            s = np.stack(right["unit"].to_numpy()) @ units.T
            earlier = pos[None, :] < right["pos"].to_numpy()[:, None]
            low, n = np.where(earlier, s, -np.inf), earlier.sum(1)
            tops = -np.sort(np.partition(-low, min(2, low.shape[1] - 1), axis=1)[:, :3], axis=1)
            best = low.argmax(1)
            near = {c: np.where(earlier, x.jaccards(right[c].tolist()), 0.0).max(1) for c, x in sets.items()}
            out.append(pd.DataFrame({
                "row_pos": right["row_pos"].to_numpy(), "top": low.max(1), "least": np.where(earlier, s, np.inf).min(1), "total": np.where(earlier, s, 0.0).sum(1), "n": n,
                "tops": [x[: min(k, 3)].tolist() for x, k in zip(tops, n.tolist(), strict=True)], "last": s[np.arange(len(s)), n - 1], "last_pos": pos[n - 1], "best_pos": pos[best], "best_row": row[best], "tj": near["title"], "xj": near["text"],
            }))
    return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _PARTS.split(", ")})


def _sent(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a row of (cluster, pos, row_pos, unit, title_tokens, text_tokens) meets.

    A cluster has about PARTS blocks, so a row is sent that often whatever its cluster's size; only beyond PARTS * MOST bytes there are more.
    """
    marks = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    own = Window.partitionBy("cluster")
    weight = (F.lit(64) + 8 * F.greatest(F.lit(0), F.size("unit") + F.size("title_tokens") + F.size("text_tokens"))).cast("long")
    x = rows.select("cluster", "pos", "row_pos", "unit", marks("title_tokens").alias("title"), marks("text_tokens").alias("text"), weight.alias("_w"))
    x = x.withColumns({"_n": F.count("*").over(own), "_all": F.sum("_w").over(own), "_upto": F.sum("_w").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))}).where("_n > 1")
    x = x.withColumn("_step", F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.ceil(F.col("_all") / F.lit(PARTS)))))
    block = lambda upto: F.floor((F.col(upto) - 1) / F.col("_step")).cast("int")
    x = x.select("cluster", "pos", "row_pos", "unit", "title", "text", block("_upto").alias("blk"), F.explode(F.sequence(F.lit(0), block("_all"))).alias("other"))
    return x.select(F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "cluster", "blk", "pos", "row_pos", "unit", "title", "text")


def _previous(rows: DataFrame) -> DataFrame:
    """The partial results of all pairs of blocks of rows."""
    key = ["cluster", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            if held and (held[-1][key].iloc[-1] == b[key].iloc[0]).all():
                new = b[key].ne(b[key].iloc[0]).any(axis=1)
            else:
                if held:
                    yield _compared(pd.concat(held))
                held, new = [], b[key].ne(b[key].shift()).any(axis=1)
                new.iloc[0] = False
            cuts = [0, *np.flatnonzero((new & b[key].ne(b[key].shift()).any(axis=1)).to_numpy()).tolist(), len(b)]
            parts = [b.iloc[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
            held.append(parts[0])
            if len(parts) > 1:
                yield pd.concat([_compared(pd.concat(held)), *map(_compared, parts[1:-1])])
                held = [parts[-1]]
        if held:
            yield _compared(pd.concat(held))

    return _sent(rows).repartition(*key).sortWithinPartitions(*key, "pos").mapInPandas(compare, _PARTS)


def previous_only(news: DataFrame, clusters: DataFrame) -> DataFrame:
    """(row_pos, cluster, the 18 features, best_previous) for clusters (row_pos, cluster)."""
    rows = P.vectorised(news).join(clusters.select("row_pos", "cluster"), "row_pos")
    order = Window.partitionBy("cluster").orderBy("published_at", "row_pos")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    scalar = rows.select(
        "row_pos", "cluster", "pos", F.coalesce(T.days_between(F.lag("published_at").over(order), F.col("published_at")), F.lit(-1.0)).alias("days_since_previous"),
        T.days_between(F.first("published_at").over(order), F.col("published_at")).alias("days_since_cluster_start"),
        F.length("title").cast("long").alias("title_length"), F.length("text").cast("long").alias("text_length"), "numbers",
    )
    # A number is new in the row that has it first in the cluster, and shared in any later one.
    each = rows.select("cluster", F.explode("numbers").alias("number"), F.struct("pos", "row_pos").alias("at"))
    fresh = each.groupBy("cluster", "number").agg(F.min("at").alias("at")).groupBy("at.row_pos").agg(F.count("*").alias("new"))
    agg = _previous(rows).groupBy("row_pos").agg(
        F.max("top").alias("max_prev_similarity"), (F.sum("total") / F.sum("n")).alias("mean_prev_similarity"), F.min("least").alias("min_prev_similarity"), F.sum("total").alias("r"), F.sort_array(F.flatten(F.collect_list("tops")), False).alias("sims"),
        F.max_by("last", "last_pos").alias("last_prev_similarity"), F.max("tj").alias("title_jaccard_max"), F.max("xj").alias("text_jaccard_max"), F.min_by("best_row", F.struct(-F.col("top"), "best_pos")).alias("best_previous"),
    )
    out = scalar.join(agg, "row_pos", "left").join(fresh, "row_pos", "left")
    out = out.withColumn("S", F.sum(F.lit(1.0) + 2 * F.coalesce("r", F.lit(0.0))).over(Window.partitionBy("cluster").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    centroid = F.when((F.col("S") > 0) & F.col("r").isNotNull(), F.col("r") / F.sqrt("S")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    new = F.coalesce("new", F.lit(0))
    return out.select(
        "row_pos", "cluster", F.col("pos").cast("long").alias("position_in_cluster"), (F.col("pos")).cast("long").alias("cluster_size_so_far"), "days_since_previous", "days_since_cluster_start",
        *[zero(c).alias(c) for c in ("max_prev_similarity", "mean_prev_similarity", "min_prev_similarity")],
        zero(_top_mean("sims", 2)).alias("top2_mean_similarity"), zero(_top_mean("sims", 3)).alias("top3_mean_similarity"), zero(F.col("last_prev_similarity")).alias("last_prev_similarity"),
        centroid.alias("previous_centroid_similarity"), (F.lit(1.0) - centroid).alias("previous_centroid_distance"), zero(F.col("title_jaccard_max")).alias("title_jaccard_max"), zero(F.col("text_jaccard_max")).alias("text_jaccard_max"),
        (F.size("numbers") - new).cast("long").alias("shared_numbers_count"), new.cast("long").alias("new_numbers_count"), "title_length", "text_length", "best_previous",
    )


#: Derived features as SQL over the 18; a missing value counts as in DEFAULTS.
DERIVED = {
    "max_prev_distance": "1 - max_prev_similarity",
    "last_prev_distance": "1 - last_prev_similarity",
    "centroid_similarity_gap": "max_prev_similarity - previous_centroid_similarity",
    "max_vs_mean_similarity_gap": "max_prev_similarity - mean_prev_similarity",
    "max_vs_centroid_similarity_gap": "max_prev_similarity - previous_centroid_similarity",
    "semantic_lexical_gap": "max_prev_similarity - text_jaccard_max",
    "title_text_jaccard_gap": "title_jaccard_max - text_jaccard_max",
    "similarity_per_day": "CASE WHEN days_since_previous <> -1 THEN max_prev_similarity / (1 + days_since_previous) ELSE 0 END",
    "distance_per_day": "CASE WHEN days_since_previous <> -1 THEN (1 - max_prev_similarity) / (1 + days_since_previous) ELSE 0 END",
    "is_recent_high_similarity": "CASE WHEN max_prev_similarity >= 0.9 AND days_since_previous <= 2 THEN 1 ELSE 0 END",
    "is_old_high_similarity": "CASE WHEN max_prev_similarity >= 0.9 AND days_since_previous > 14 THEN 1 ELSE 0 END",
    "log_cluster_size_so_far": "ln(1 + greatest(cluster_size_so_far, 0))",
    "log_position_in_cluster": "ln(1 + greatest(position_in_cluster, 0))",
    "cluster_velocity": "cluster_size_so_far / (1 + days_since_cluster_start)",
    "is_early_cluster_item": "CASE WHEN position_in_cluster <= 2 THEN 1 ELSE 0 END",
    "is_late_cluster_item": "CASE WHEN position_in_cluster >= 5 THEN 1 ELSE 0 END",
    "has_new_numbers": "CASE WHEN new_numbers_count > 0 THEN 1 ELSE 0 END",
    "new_numbers_ratio": "CASE WHEN shared_numbers_count + new_numbers_count > 0 THEN new_numbers_count / (shared_numbers_count + new_numbers_count + 1e-6) ELSE 0 END",
}
DEFAULTS = {"days_since_previous": 9999.0}


def derived(f: DataFrame) -> DataFrame:
    """row_pos and the 18 derived features. A gap of exactly -1 day (a cluster's first row) gives rate 0, as infinities do."""
    filled = f.na.fill({c: DEFAULTS.get(c, 0.0) for c in COLUMNS})
    return filled.select("row_pos", *[F.expr(f"cast({x} AS double)").alias(name) for name, x in DERIVED.items()])


def density(news: DataFrame, days: float) -> DataFrame:
    """(row_pos, n): earlier rows of the topic in the last days; ties by row_pos.

    A range frame counts them. A row stands in the bucket of its time, as wide as the
    window, and for counting in the next one too, so that a topic is split by time.
    """
    width = int(days * P.DAY)
    x = news.select("topic", "row_pos", F.unix_micros("published_at").alias("at")).withColumn("bucket", F.floor(F.col("at") / F.lit(width)))
    both = x.withColumn("own", F.lit(True)).unionByName(x.withColumn("bucket", F.col("bucket") + 1).withColumn("own", F.lit(False)))
    upto = Window.partitionBy("topic", "bucket").orderBy("at").rangeBetween(-width, 0)
    ties = Window.partitionBy("topic", "bucket", "at").orderBy(F.col("row_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)  # the row itself and later ones at its instant
    return both.withColumn("n", F.count("*").over(upto) - F.count("*").over(ties)).where("own").select("row_pos", "n")


def topic_context(news: DataFrame, days: float = 30) -> DataFrame:
    """(row_pos, n, max, mean of the top 3): similarities to the topic's earlier rows in the last days."""
    out = news.select("row_pos").join(tiles.best_earlier(news, days), "row_pos", "left")
    top3 = F.aggregate("tops.s", F.lit(0.0), lambda s, x: s + x) / F.size("tops")
    return out.select("row_pos", F.coalesce("n", F.lit(0)).cast("long").alias("topic_prev_count"), F.coalesce(F.col("tops.s")[0], F.lit(0.0)).alias("topic_prev_max"), F.coalesce(top3, F.lit(0.0)).alias("topic_prev_top3"))
