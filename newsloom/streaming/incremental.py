"""Incremental story assignment: sequential within a segment of a topic, parallel across segments.

A segment ends where a topic is silent for longer than the window and no stored story
spans the silence; rows on either side can't meet.

Each new row, in (published_at, numeric id, id) order, sees the rows before it and the
stored history of its topic within the window on either side. Clusters with a strong
candidate are joined; two or more strong components merge; otherwise evidence with a
clear margin attaches; else a cluster is opened. Rows that come late are accepted.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.components import materialise

DAY = 86_400_000_000
_TOKEN, _NUMBER = re.compile("[A-Za-zА-Яа-яЁё0-9]+"), re.compile("[0-9]+(?:[.,][0-9]+)?")


@dataclass(frozen=True)
class Config:
    strong: float = 0.82
    attach: float = 0.75
    days: float = 14
    attach_days: float = 7
    title_jaccard: float = 0.15
    shared_numbers: int = 1
    margin: float = 0.03
    prefix: str = "event"


@dataclass
class Item:
    news_id: str
    at: int
    unit: np.ndarray
    title: frozenset
    numbers: frozenset
    cluster: str = ""
    component: str = ""
    stored: bool = False
    affected: bool = False  # by a row that was added
    method: str = "baseline"
    parent: str | None = None
    similarity: float | None = None
    attached_to: str | None = None
    previous: tuple[str, str] | None = None


@dataclass
class Candidate:
    cluster: str
    strong: bool = False
    similarity: float = -2.0
    days: float = float("inf")
    best: tuple = ()
    parent: Item | None = None
    components: set[str] = field(default_factory=set)


def _item(r, stored: bool) -> Item:
    v = np.asarray(r.embedding, float)
    text = f"{r.title or ''}\n{r.text or ''}"
    it = Item(str(r.news_id), int(r.micros), v / max(float(np.linalg.norm(v)), 1e-12), frozenset(x.lower() for x in _TOKEN.findall(r.title or "")), frozenset(_NUMBER.findall(text.replace(",", "."))), stored=stored)
    if stored:
        it.cluster, it.component = r.cluster_id, r.component_id
        it.method, it.parent, it.attached_to = r.assignment_method, r.assignment_parent_news_id, r.attached_to_component_id
        it.similarity = None if r.assignment_similarity is None or pd.isna(r.assignment_similarity) else float(r.assignment_similarity)
    return it


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


class Topic:
    """The rows of one topic that new ones can meet, sorted by time in arrays, and what is known of their stories.

    ``sizes`` and ``last`` hold, for each story, all its rows and the latest time, also of rows
    that are no longer held; without them they are taken from ``history``.
    """

    def __init__(self, config: Config, history: list[Item], sizes: dict[str, int] | None = None, last: dict[str, int] | None = None):
        self.c = config
        self.items = sorted(history, key=lambda x: x.at)
        self.times = [x.at for x in self.items]
        self.units = np.array([x.unit for x in self.items]) if history else np.empty((0, 0))
        self.sizes, self.last = dict(sizes or {}), dict(last or {})
        self.members: dict[str, list[Item]] = {}
        self.of_component: dict[str, list[Item]] = {}
        for x in history:
            self.members.setdefault(x.cluster, []).append(x)
            self.of_component.setdefault(x.component, []).append(x)
            if sizes is None:
                self.sizes[x.cluster] = self.sizes.get(x.cluster, 0) + 1
                self.last[x.cluster] = max(self.last.get(x.cluster, x.at), x.at)

    def _hold(self, now: Item) -> None:
        n = len(self.items)
        if n == 0:
            self.units = np.empty((16, len(now.unit)))
        elif n == len(self.units):
            self.units = np.concatenate([self.units, np.empty_like(self.units)])
        at = bisect.bisect_right(self.times, now.at)
        self.units[at + 1 : n + 1] = self.units[at:n].copy()
        self.units[at] = now.unit
        self.items.insert(at, now)
        self.times.insert(at, now.at)
        self.members.setdefault(now.cluster, []).append(now)
        self.of_component.setdefault(now.component, []).append(now)
        self.sizes[now.cluster] = self.sizes.get(now.cluster, 0) + 1
        self.last[now.cluster] = max(self.last.get(now.cluster, now.at), now.at)

    def candidates(self, now: Item) -> list[Candidate]:
        c, found = self.c, {}
        low, high = bisect.bisect_left(self.times, now.at - c.days * DAY), bisect.bisect_right(self.times, now.at + c.days * DAY)
        if low == high:
            return []
        sims = self.units[low:high] @ now.unit
        for i in np.flatnonzero(sims >= min(c.strong, c.attach)).tolist():
            x, s = self.items[low + i], float(sims[i])
            days = abs(now.at - x.at) / DAY
            title, shared = _jaccard(x.title, now.title), len(x.numbers & now.numbers)
            strong = s >= c.strong
            if not strong and not (s >= c.attach and days <= c.attach_days and (title >= c.title_jaccard or shared >= c.shared_numbers)):
                continue
            k = found.setdefault(x.cluster, Candidate(x.cluster))
            k.strong |= strong
            k.similarity, k.days = max(k.similarity, s), min(k.days, days)
            if strong:
                k.components.add(x.component)
            if not k.best or (-s, -title, -shared, days, x.at, x.news_id) < k.best:
                k.best, k.parent = (-s, -title, -shared, days, x.at, x.news_id), x
        return sorted(found.values(), key=lambda k: (-k.similarity, -self.sizes[k.cluster], k.days, k.cluster))

    def fresh(self, base: str, taken) -> str:
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        return name

    def merge(self, strong: list[Candidate]) -> tuple[list[str], list[str]] | None:
        """Clusters and components joined into the first of each, if a row bridges two components."""
        components = list(dict.fromkeys(x for k in strong for x in sorted(k.components)))
        if len(components) < 2:
            return None
        clusters = [k.cluster for k in strong]
        moved = {id(x): (x, x.cluster, x.component) for k in clusters[1:] for x in self.members.get(k, [])} | {id(x): (x, x.cluster, x.component) for k in components[1:] for x in self.of_component.get(k, [])}
        for x, cluster, component in moved.values():
            x.cluster = clusters[0] if cluster in clusters[1:] else cluster
            x.component = components[0] if component in components[1:] else component
            if x.previous is None and (x.cluster, x.component) != (cluster, component):
                x.previous = (cluster, component)
        for names, groups in ((clusters, self.members), (components, self.of_component)):
            for k in names[1:]:
                groups.setdefault(names[0], []).extend(groups.pop(k, []))
        for k in clusters[1:]:
            self.sizes[clusters[0]] += self.sizes.pop(k)
            self.last[clusters[0]] = max(self.last[clusters[0]], self.last.pop(k))
        return clusters, components

    def add(self, now: Item) -> dict:
        found = self.candidates(now)
        strong = [k for k in found if k.strong]
        merged = self.merge(strong)
        digest = hashlib.sha1(now.news_id.encode()).hexdigest()[:12]
        own = self.fresh(f"incremental_base_{digest}", self.of_component)
        second, margin, review = None, None, False
        if strong:
            best = strong[0]
            now.cluster, now.component, update = best.cluster, merged[1][0] if merged else sorted(best.components)[0], "baseline_merge" if merged else "baseline"
            now.parent, now.similarity = best.parent.news_id, best.similarity
        elif found:
            best = found[0]
            now.similarity = best.similarity
            if len(found) > 1:
                second = found[1].similarity
                margin = best.similarity - second
            if margin is None or margin >= self.c.margin:
                now.cluster, now.component, now.method, update = best.cluster, own, "attach", "attach"
                now.parent, now.attached_to = best.parent.news_id, best.parent.component
            else:
                now.cluster, now.component, update, review = self.fresh(f"{self.c.prefix}_{digest}", self.sizes), own, "new_cluster_ambiguous", True
        else:
            now.cluster, now.component, update = self.fresh(f"{self.c.prefix}_{digest}", self.sizes), own, "new_cluster"
        late = now.cluster in self.last and now.at < self.last[now.cluster]
        stored = [x for x in self.members.get(now.cluster, []) if x.stored and (merged or x.at > now.at)] if merged or late else []
        later = sum(x.at > now.at for x in stored)
        first = sorted((x for x in stored if not x.affected), key=lambda x: (x.at, x.news_id))
        for x in first:
            x.affected = True
        self._hold(now)
        return {"item": now, "update_method": update, "second_best_similarity": second, "assignment_margin": margin, "assignment_needs_review": review, "late_arrival": late, "affected_historical_count": later, "affected": [x.news_id for x in first], "merged_cluster_ids": merged[0] if merged else [], "merged_component_ids": merged[1] if merged else []}

    def closed(self, before: int) -> list[tuple[str, int, int]]:
        """Forget rows and stories whose latest row is earlier; (story, size, latest) of those stories."""
        out = sorted((k, self.sizes.pop(k), self.last[k]) for k in [k for k, at in self.last.items() if at < before])
        for k, _, _ in out:
            del self.last[k]
        n = bisect.bisect_left(self.times, before)
        gone = {id(x) for x in self.items[:n]}
        if gone:
            self.items, self.times, self.units = self.items[n:], self.times[n:], self.units[n:]
            for groups in (self.members, self.of_component):
                for k in [k for k, own in groups.items() if any(id(x) in gone for x in own)]:
                    groups[k] = [x for x in groups[k] if id(x) not in gone]
                    if not groups[k]:
                        del groups[k]
        return out


OUT = "topic string, news_id string, cluster_id string, component_id string, assignment_method string, update_method string, assignment_parent_news_id string, assignment_similarity double, attached_to_component_id string, second_best_similarity double, assignment_margin double, assignment_needs_review boolean, late_arrival boolean, affected_historical_count long, merged_cluster_count long, merged_cluster_ids array<string>, merged_component_ids array<string>, previous_cluster_id string, previous_component_id string, affected array<string>"
STATE = ["news_id", "topic", "published_at", "title", "text", "embedding", "cluster_id", "component_id", "assignment_method", "assignment_parent_news_id", "assignment_similarity", "attached_to_component_id"]


def _number(news_id: str) -> float:
    try:
        return float(news_id)
    except ValueError:
        return float("inf")


def assigned(history: DataFrame, new: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Assignments of new rows and changes of stored ones (update_method cluster_merge).

    history holds STATE, new the first six columns. One task handles a segment, as a row's
    place depends on all rows of its segment before it; segments run in parallel.
    affected names the stored rows that no new row before affected, so each stands in one list
    and all lists together are no longer than the history; affected_historical_count counts all later ones.
    """

    def run(key: tuple, stored: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        past = [_item(r, True) for r in stored.itertuples(index=False)]
        state, rows = Topic(config, past), []
        for r in sorted(fresh.itertuples(index=False), key=lambda r: (r.micros, _number(str(r.news_id)), str(r.news_id))):
            rows.append(state.add(_item(r, False)))
        out = []
        for r in rows:
            x = r["item"]
            out.append((key[0], x.news_id, x.cluster, x.component, x.method, r["update_method"], x.parent, x.similarity, x.attached_to, r["second_best_similarity"], r["assignment_margin"], r["assignment_needs_review"], r["late_arrival"], r["affected_historical_count"], max(0, len(r["merged_cluster_ids"]) - 1), r["merged_cluster_ids"], r["merged_component_ids"], None, None, r["affected"]))
        for x in past:
            if x.previous:
                out.append((key[0], x.news_id, x.cluster, x.component, x.method, "cluster_merge", x.parent, x.similarity, x.attached_to, None, None, False, False, 0, 0, [], [], *x.previous, []))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    micros = F.unix_micros("published_at").alias("micros")
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    h = history.select("news_id", "topic", micros, "title", "text", vector, *STATE[6:])
    n = new.select("news_id", "topic", micros, "title", "text", vector)
    # Stories and new rows as intervals of time; those that overlap, or nearly so, are one segment.
    spans = h.groupBy("topic", "cluster_id").agg(F.min("micros").alias("a"), F.max("micros").alias("b")).unionByName(n.select("topic", F.lit(None).cast("string").alias("cluster_id"), F.col("micros").alias("a"), F.col("micros").alias("b")).distinct())
    order = Window.partitionBy("topic").orderBy("a", "b", "cluster_id")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("segment", F.sum(F.coalesce((F.col("a") - reached > int(config.days * DAY)).cast("int"), F.lit(0))).over(order))
    spans = materialise(spans)
    same = lambda x, y: x.eqNullSafe(y)
    of_story = spans.where("cluster_id IS NOT NULL").select(F.col("topic").alias("_t"), F.col("cluster_id").alias("_c"), (F.col("segment") + 0).alias("segment"))
    of_row = spans.where("cluster_id IS NULL").select(F.col("topic").alias("_t"), F.col("a").alias("_a"), (F.col("segment") + 0).alias("segment"))
    h = h.join(of_story, same(F.col("topic"), F.col("_t")) & (F.col("cluster_id") == F.col("_c"))).drop("_t", "_c")
    n = n.join(of_row, same(F.col("topic"), F.col("_t")) & (F.col("micros") == F.col("_a"))).drop("_t", "_a")
    h, n = (x.toDF(*x.columns) for x in (h, n))  # the two may come from one table
    return h.groupBy("topic", "segment").cogroup(n.groupBy("topic", "segment")).applyInPandas(run, OUT)


def checked(history: DataFrame, new: DataFrame) -> None:
    """Refuse repeated ids and rows that are stored already."""
    if new.groupBy("news_id").count().where("count > 1").limit(1).count():
        raise ValueError("new rows repeat an id")
    if new.join(history.select("news_id"), "news_id", "left_semi").limit(1).count():
        raise ValueError("new rows are stored already")


def moved(history: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of the state that changes add or change."""
    first = new.select(*STATE[:6]).unionByName(history.select(*STATE[:6]))
    return changes.select("news_id", *STATE[6:]).join(first, "news_id").select(*STATE)


def applied(history: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after changes."""
    kept = history.join(changes.select("news_id"), "news_id", "left_anti")
    return kept.select(*STATE).unionByName(moved(history, new, changes))


def recomputed(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(news_id, cluster, the 18 features) of the rows that changes affect: new ones, later rows of their clusters, rows of merged ones.

    state is the one after changes. Only clusters with an affected row are read again.
    """
    from newsloom.operators import features as W
    from newsloom.operators.components import ranked

    hit = materialise(changes.select("news_id").union(changes.select(F.explode("affected"))).distinct())
    touched = state.join(hit, "news_id", "left_semi").select("cluster_id").distinct()
    rows = state.join(touched, "cluster_id", "left_semi")
    number = F.expr("coalesce(try_cast(news_id AS double), double('infinity'))")
    rows = materialise(ranked(rows, F.col("published_at"), number, F.col("news_id"), name="row_pos"))
    f = W.previous_only(rows, rows.select("row_pos", F.col("cluster_id").alias("cluster")))
    return rows.select("row_pos", "news_id").join(hit, "news_id", "left_semi").join(f, "row_pos").drop("row_pos", "best_previous")


def segmented(news: DataFrame, days: float) -> DataFrame:
    """(topic, segment, news_id, row_pos, micros, embedding): a segment ends where a topic is silent for more than ``days``.

    Rows of different segments can't meet within the window, so each is a task of its own;
    only times are sorted over a whole topic.
    """
    x = news.select("topic", "news_id", "row_pos", F.unix_micros("published_at").alias("micros"), F.col("embedding").cast("array<double>").alias("embedding"))
    times = x.groupBy("topic", "micros").agg(F.lit(1).alias("_one")).drop("_one")
    order = Window.partitionBy("topic").orderBy("micros")
    gap = (F.col("micros") - F.lag("micros").over(order) > int(days * DAY)).cast("int")
    marked = times.withColumn("segment", F.sum(F.coalesce(gap, F.lit(0))).over(order))
    return x.join(marked, ["topic", "micros"])


def _unit_rows(rows: pd.DataFrame) -> np.ndarray:
    x = np.array(rows["embedding"].tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lifecycle(news: DataFrame, threshold: float = 0.75, days: float = 14, centroid_share: float = 0.6) -> DataFrame:
    """(news_id, cluster): online clusters that close after ``days`` without a row; similarity mixes centroid and closest member.

    A cluster is named by its topic and first row.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["micros", "row_pos"])
        units, at, names = _unit_rows(rows), rows["micros"].to_numpy(), rows["news_id"].astype(str).tolist()
        n = len(units)
        owner, sums, last, first = np.empty(n, np.int64), np.empty_like(units), np.empty(n, np.int64), np.empty(n, np.int64)
        clusters = low = 0  # clusters before ``low`` are closed
        for r, v in enumerate(units):
            while low < clusters and at[r] - last[low] > days * DAY:
                low += 1
            best = -1
            if low < clusters:
                begin = int(first[low])
                closest = np.full(clusters - low, -np.inf)
                own = owner[begin:r] - low
                np.maximum.at(closest, own[own >= 0], (units[begin:r] @ v)[own >= 0])
                mean = sums[low:clusters] @ v / np.maximum(np.linalg.norm(sums[low:clusters], axis=1), 1e-12)
                s = np.where(at[r] - last[low:clusters] <= days * DAY, centroid_share * mean + (1 - centroid_share) * closest, -np.inf)
                best = low + int(s.argmax()) if s.max() >= threshold else -1
            if best < 0:
                best, clusters = clusters, clusters + 1
                sums[best], first[best] = 0, r
            owner[r], last[best] = best, at[r]
            sums[best] += v
        return pd.DataFrame({"news_id": names, "cluster": [f"{key[0]}_{names[first[k]]}" for k in owner]})

    return segmented(news, days).groupBy("topic", "segment").applyInPandas(run, "news_id string, cluster string")


def nearest_topic(news: DataFrame, threshold: float = 0.75, days: float = 5) -> DataFrame:
    """(news_id, cluster): each row joins its most similar earlier row's group if similar and recent enough, else opens one.

    A group is named by its topic and first row.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["micros", "row_pos"])
        units, at, ids = _unit_rows(rows), rows["micros"].to_numpy(), rows["news_id"].astype(str).tolist()
        names: list[str] = []
        begin = np.searchsorted(at, at - int(days * DAY), side="left")
        for r, v in enumerate(units):
            s = units[begin[r] : r] @ v
            near = int(s.argmax()) if len(s) else -1
            names.append(names[begin[r] + near] if near >= 0 and s[near] >= threshold else f"{key[0]}_{ids[r]}")
        return pd.DataFrame({"news_id": ids, "cluster": names})

    return segmented(news, days).groupBy("topic", "segment").applyInPandas(run, "news_id string, cluster string")


def checkpoints(first, last, bootstrap_days: int = 14, step_days: int = 7) -> Iterator[tuple]:
    """(from, to) of the bootstrap and each weekly step, right-open; the last ends just after the last row."""
    at = pd.Timestamp(first).normalize() + pd.Timedelta(days=bootstrap_days)
    end = pd.Timestamp(last) + pd.Timedelta(microseconds=1)
    yield pd.Timestamp(first), min(at, end)
    while at < end:
        yield at, min(at + pd.Timedelta(days=step_days), end)
        at += pd.Timedelta(days=step_days)
