"""Story assignment with keyed state: one state for each topic, kept by the stream itself.

``assigned`` runs the incremental step inside transformWithState. A topic's state is its
rows of the last ``days`` before the watermark (a list), and size and latest time of each
open story (a map); an event-time timer closes stories that have been silent for as long.
Rows and stories that no later row can meet are dropped then, so the state is bounded by
the window and not by the stream. The state store and its checkpoint bring it back after a restart.

The result only grows: a row for each article, and one for each story that closes. A row
that merges stories names them, and ``current`` follows those merges, so no earlier row is
written again. Rows come in order of time within a batch; rows behind the watermark are
dropped by Spark. A topic is sequential by nature, as each row's place depends on those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsloom.operators.components import materialise

from . import incremental as I

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "kind string, topic string, news_id string, cluster_id string, component_id string, assignment_method string, update_method string, assignment_parent_news_id string, assignment_similarity double, attached_to_component_id string, second_best_similarity double, assignment_margin double, assignment_needs_review boolean, late_arrival boolean, affected_historical_count long, merged_cluster_ids array<string>, merged_component_ids array<string>, size long, last long"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
_ROW = "news_id string, at long, unit array<double>, title array<string>, numbers array<string>, cluster string, component string"
_SIDE = 1000  # microseconds in a millisecond, in which timers and watermarks are given


class Stories(StatefulProcessor):
    """The incremental step of one topic."""

    def __init__(self, config: I.Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROW)
        self.stories = handle.getMapState("stories", "cluster string", "size long, last long")

    def _read(self) -> I.Topic:
        rows = [I.Item(i, at, np.array(unit), frozenset(title), frozenset(numbers), cluster, component, True) for i, at, unit, title, numbers, cluster, component in self.rows.get()] if self.rows.exists() else []
        known = {k[0]: v for k, v in self.stories.iterator()}
        return I.Topic(self.config, rows, {k: v[0] for k, v in known.items()}, {k: v[1] for k, v in known.items()})

    def _write(self, topic: I.Topic, whole: bool, new: list[I.Item]) -> None:
        """The state after a batch: new rows are added, and the list is written anew only if old ones have changed."""
        as_row = lambda x: (x.news_id, x.at, x.unit.tolist(), sorted(x.title), sorted(x.numbers), x.cluster, x.component)
        if whole and topic.items:
            self.rows.put([as_row(x) for x in topic.items])
        elif whole:
            self.rows.clear()
        elif new:
            self.rows.appendList([as_row(x) for x in new])
        for k in [k[0] for k in self.stories.keys()]:  # noqa: SIM118  a state's method
            if k not in topic.sizes:
                self.stories.removeKey((k,))
        for k in topic.sizes if whole else {x.cluster for x in new}:
            self.stories.updateValue((k,), (topic.sizes[k], topic.last[k]))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if topic.last:
            self.handle.registerTimer((min(topic.last.values()) + int(self.config.days * I.DAY)) // _SIDE + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        topic = self._read()
        known, new = {x.news_id for x in topic.items}, {}
        for part in rows:
            for r in part.itertuples(index=False):
                if r.news_id not in known:
                    new.setdefault(r.news_id, I._item(r, False))
        out, merged = [], False
        ordered = sorted(new.values(), key=lambda x: (x.at, I._number(x.news_id), x.news_id))
        for x in ordered:
            r = topic.add(x)
            merged |= bool(r["merged_cluster_ids"])
            out.append(("assigned", key[0], x.news_id, x.cluster, x.component, x.method, r["update_method"], x.parent, x.similarity, x.attached_to, r["second_best_similarity"], r["assignment_margin"], r["assignment_needs_review"], r["late_arrival"], r["affected_historical_count"], r["merged_cluster_ids"], r["merged_component_ids"], None, x.at))
        self._write(topic, merged, ordered)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        topic = self._read()
        before = timerValues.getCurrentWatermarkInMs() * _SIDE - int(self.config.days * I.DAY)
        out = [("closed", key[0], None, k, None, None, None, None, None, None, None, None, None, None, None, [], [], size, last) for k, size, last in topic.closed(before)]
        self._write(topic, True, [])
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def assigned(articles: DataFrame, config: I.Config = I.Config(), late: str = "1 day") -> DataFrame:  # noqa: B008
    """The rows OUT of a stream of articles (news_id, topic, published_at, title, text, embedding)."""
    articles.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = articles.withWatermark("published_at", late).select("topic", "published_at", "news_id", F.unix_micros("published_at").alias("micros"), "title", "text", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("topic").transformWithStateInPandas(Stories(config), OUT, "Append", "EventTime")


def started(articles: DataFrame, path: str, checkpoint: str, config: I.Config = I.Config(), late: str = "1 day", available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """Write the result as Parquet files; started again with the same folders, it goes on where it stopped."""
    w = assigned(articles, config, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _roots(merges: DataFrame) -> DataFrame:
    """(id, root): where each merged id ends, by doubling the way that is known; the table has a row for each merge."""
    out = materialise(merges)
    while True:
        ahead = out.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = materialise(out.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        out = further.select("id", "root")
        if not further.where("moved").limit(1).count():
            return out


def current(result: DataFrame) -> DataFrame:
    """(topic, news_id, cluster_id, component_id, ...) of all articles, after all merges so far."""
    rows = result.where("kind = 'assigned'")
    for c in ("cluster", "component"):
        ids = F.col(f"merged_{c}_ids")
        merges = rows.where(F.size(ids) > 1).select(ids[0].alias("root"), F.explode(F.slice(ids, 2, F.size(ids) - 1)).alias("id")).where("id <> root").select("id", "root")
        roots = _roots(merges).withColumnRenamed("root", "_root")
        rows = rows.join(roots, rows[f"{c}_id"] == roots.id, "left").withColumn(f"{c}_id", F.coalesce("_root", f"{c}_id")).drop("id", "_root")
    return rows
