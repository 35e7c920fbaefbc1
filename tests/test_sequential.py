"""Queries without SQL and new operators, against plain versions."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.operators import components as C
from newsloom.operators import ivf, metrics, search, training
from newsloom.plans.base import news
from newsloom.sources import encoders, jobs, readers

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def rows(spark):
    out = news(spark, SF).select("news_id", "row_pos", "topic", F.unix_micros("published_at").alias("at"), "embedding").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["at"], r.row_pos)):
        v = np.array(r.embedding)
        by.setdefault(r.topic, []).append((r.news_id, r["at"], v / np.linalg.norm(v)))
    return by


def got(spark, name):
    return {r.news_id: r.cluster for r in entry.queries()[name](spark, SF).collect()}


def test_online_lifecycle(spark, rows):
    want = {}
    for topic, items in rows.items():
        groups = []
        for name, at, v in items:
            scored = []
            for i, g in enumerate(groups):
                if at - g[-1][1] <= 14 * DAY:
                    total = sum(x for _, _, x in g)
                    scored.append((0.6 * (total / np.linalg.norm(total)) @ v + 0.4 * max(x @ v for _, _, x in g), -i))
            if scored and max(scored)[0] >= 0.25:
                groups[-max(scored)[1]].append((name, at, v))
            else:
                groups.append([(name, at, v)])
        want |= {n: f"{topic}_{g[0][0]}" for g in groups for n, _, _ in g}
    assert got(spark, "g08_online_lifecycle") == want and len(set(want.values())) < len(want)


def test_nearest_topic(spark, rows):
    want = {}
    for topic, items in rows.items():
        for i, (name, at, v) in enumerate(items):
            near = [(x @ v, -j) for j, (_, t, x) in enumerate(items[:i]) if at - t <= 5 * DAY]
            want[name] = want[items[-max(near)[1]][0]] if near and max(near)[0] >= 0.25 else f"{topic}_{name}"
    assert got(spark, "g09_nearest_topic") == want and len(set(want.values())) < len(want)


def test_segments_split_a_topic_at_silences(spark):
    from newsloom.streaming import incremental as I

    at = [0, 3, 17.1, 18, 40]
    df = spark.createDataFrame([(str(i), i, "t", int(x * DAY), [1.0]) for i, x in enumerate(at)], "news_id string, row_pos long, topic string, micros long, embedding array<double>").withColumn("published_at", F.timestamp_micros("micros"))
    assert [r.segment for r in I.segmented(df, 14).orderBy("row_pos").collect()] == [0, 0, 1, 1, 2]


def test_increment_by_segments_equals_one_by_topic(spark):
    """Segments only split what can't meet: the same assignments as with a whole topic in one task."""
    from newsloom.streaming import incremental as I

    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        rows.append((str(i), "ab"[i % 2], float(rng.choice([0, 40, 90]) + rng.random() * 20), f"t{i % 7}", f"x {i % 5} 1{i % 3}", rng.random(4).tolist()))
    df = spark.createDataFrame(rows, "news_id string, topic string, day double, title string, text string, embedding array<double>").withColumn("published_at", F.timestamp_micros((F.col("day") * DAY).cast("long"))).drop("day")
    old, new = df.where("CAST(news_id AS INT) % 3 > 0"), df.where("CAST(news_id AS INT) % 3 = 0")
    names = {c: F.concat(F.lit("c"), (F.col("news_id").cast("int") % 4).cast("string"), "topic", F.floor(F.unix_micros("published_at") / (35 * DAY)).cast("string")) for c in ("cluster_id", "component_id")}
    rest = {"assignment_method": F.lit("baseline"), "assignment_parent_news_id": F.lit(None).cast("string"), "assignment_similarity": F.lit(None).cast("double"), "attached_to_component_id": F.lit(None).cast("string")}
    old = old.withColumns(names | rest).select(*I.STATE)
    conf = I.Config(0.97, 0.9, 14, 7, 0.1, 1, 0.01)
    past, want = old.collect(), []
    for topic in "ab":
        stored = [r for r in past if r.topic == topic]
        frame = lambda rs, cols: pd.DataFrame([[getattr(r, c) if c != "micros" else int(r.published_at.timestamp() * 1e6) for c in cols] for r in rs], columns=cols)
        cols = ["news_id", "topic", "micros", "title", "text", "embedding"]
        state = I.Topic(conf, [I._item(r, True) for r in frame(stored, cols + I.STATE[6:]).itertuples(index=False)])
        fresh = sorted(frame([r for r in new.collect() if r.topic == topic], cols).itertuples(index=False), key=lambda r: (r.micros, float(r.news_id)))
        done = [state.add(I._item(r, False)) for r in fresh]
        want += [(topic, d["item"].news_id, d["item"].cluster, d["update_method"]) for d in done]
    got = sorted((r.topic, r.news_id, r.cluster_id, r.update_method) for r in I.assigned(old, new.select(*I.STATE[:6]), conf).collect() if r.update_method != "cluster_merge")
    assert got == sorted(want) and len({x[3] for x in want}) > 1


def test_seeded_sample(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()
    want = sorted(r.doc_id for r in sorted(d, key=lambda r: (r.h, r.doc_id))[:100])
    assert sorted(r.doc_id for r in entry.queries()["t08_seeded_sample"](spark, SF).collect()) == want


def test_budgeted_clusters(spark):
    from newsloom.plans.base import clusters

    sizes = {}
    for r in clusters(spark, SF).collect():
        sizes[r.component] = sizes.get(r.component, 0) + 1
    n, want = 0, []
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        if n < 60 and n + sizes[c] <= 80:
            want.append(c)
            n += sizes[c]
    assert sorted(r.cluster for r in entry.queries()["t10_budgeted_clusters"](spark, SF).collect()) == sorted(want)


def test_trained_classifier(spark):
    """Held-out probabilities order the target, which is a threshold on one of the features."""
    out = entry.queries()["x06_trained_classifier"](spark, SF).collect()
    assert all(0 <= r.p <= 1 for r in out)
    by = [[r.p for r in out if r.target == t] for t in (0, 1)]
    if all(by):
        assert np.mean(by[1]) > np.mean(by[0])


def test_threshold_on_a_validation_fold_and_stored_models(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.random((600, 2))
    data = [(i, float(a), float(b), int(a + 0.2 * b > 0.9), 1.0) for i, (a, b) in enumerate(x)]  # one in five
    df = spark.createDataFrame(data, "row_pos long, a double, b double, target int, weight double")
    model, sweep = training.tuned(df, ["a", "b"])
    f1 = {r.threshold: r.f1 for r in sweep.collect()}
    assert model.threshold == min(t for t, v in f1.items() if v == max(f1.values())) and max(f1.values()) > 0.85
    model.save(str(tmp_path / "m"), spark)
    again = training.Classifier.load(str(tmp_path / "m"), spark)
    first, second = (sorted(map(tuple, m.predicted(df).select("row_pos", "predicted", "p_significant").collect())) for m in (model, again))
    assert first == second and again.columns == ["a", "b"]
    right = {i: t for i, _, _, t, _ in data}
    assert np.mean([right[i] == p for i, p, _ in first]) > 0.9


def test_trained_adapter(spark):
    from newsloom.operators import adapter

    rng = np.random.default_rng(9)
    story = np.arange(240) % 40
    x = np.concatenate([rng.normal(size=(40, 4))[story] + 0.2 * rng.normal(size=(240, 4)), 1.5 * rng.normal(size=(240, 12))], 1)  # four places tell, twelve are noise
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(story, x, strict=True))], "row_pos long, story int, embedding array<double>")
    train = rows.where("story < 25")
    other = [(int(a), int(b)) for a, b in rng.integers(0, 240, (900, 2)) if story[a] != story[b] and max(story[a], story[b]) < 25]
    pairs = adapter.pairs_of(train, "story", spark.createDataFrame(other, "a long, b long"))
    assert pairs.where("same").count() == 25 * 15
    w, told = adapter.trained(pairs, rounds=25)
    assert told[-1][0] < told[0][0]
    w2, _ = adapter.trained(pairs.repartition(7), rounds=25)
    assert np.array_equal(w, w2)  # however pairs are dealt

    def recall(v):  # of the five mates of rows whose stories were not trained on, among the five nearest
        own = np.flatnonzero(story >= 25)
        s = v[own] @ v[own].T
        np.fill_diagonal(s, -2)
        return np.mean([(story[own][np.argsort(-r)[:5]] == story[own][i]).mean() for i, r in enumerate(s)])

    z = x @ w
    assert recall(z / np.linalg.norm(z, axis=1, keepdims=True)) > recall(x) + 0.1
    out = {r.same: r for r in entry.queries()["x07_trained_adapter"](spark, SF).collect()}
    assert out[True].after - out[False].after >= out[True].before - out[False].before - 1e-6
    with pytest.raises(ValueError):
        adapter.trained(pairs.where("false"))


def test_feature_importances(spark):
    out = entry.queries()["x12_feature_importances"](spark, SF).collect()
    assert {r.feature for r in out} == {"max_prev_similarity", "days_since_previous", "text_length"}
    assert [r.importance for r in out] == sorted((r.importance for r in out), reverse=True) and abs(sum(r.importance for r in out) - 1) < 1e-6


def test_strict_order(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "news_id string, place long")
    cache = spark.createDataFrame([("a", 0, [1.0]), ("b", 1, [2.0])], "news_id string, place long, embedding array<double>")
    assert {r.news_id: r.embedding for r in readers.strictly_aligned(ids, cache).collect()} == {"a": [1.0], "b": [2.0]}
    swapped = cache.withColumn("place", 1 - F.col("place"))
    longer = cache.union(spark.createDataFrame([("c", 2, [3.0])], cache.schema))
    for bad in (swapped, longer, cache.limit(1)):
        with pytest.raises(Exception, match="place "):
            readers.strictly_aligned(ids, bad).collect()


def test_budget_skips_what_does_not_fit(spark):
    from newsloom.operators import eda

    df = spark.createDataFrame([(i, s) for i, s in enumerate([9, 5, 5, 0, 4, 3, 1, 1, 1, 1])], "cluster long, size long")
    for least, most in ((8, 10), (10, 10), (12, 13), (20, 21), (3, 2), (100, 100)):
        n, want = 0, []
        for r in df.collect():
            if 0 < r.size and n < least and n + r.size <= most:
                n, want = n + r.size, [*want, r.cluster]
        assert [r.cluster for r in eda.budgeted(df, least, most, F.col("cluster")).collect()] == want


def test_weighted_training_and_importances(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b), int(a > 0.5)) for i, (a, b) in enumerate(rng.random((120, 2)))]
    df = spark.createDataFrame(data, "row_pos long, a double, b double, target int")
    both = training.weighted_union(df.where("row_pos < 60"), df.where("row_pos >= 30"))
    assert {(r.weight, r["count"]) for r in both.groupBy("weight").count().collect()} == {(1.0, 60), (0.35, 60)}
    for kind in ("logistic", "trees"):
        first = training.importances(training.fitted(both, ["b", "a"], kind), ["b", "a"], spark).first()
        assert first.feature == "a" and first.importance > 0


def test_index_with_all_cells_is_exact(spark):
    n = news(spark, SF).select("news_id", "embedding")
    asked = n.where("news_id IN ('0', '7')").select(F.col("news_id").alias("query_id"), F.col("embedding").alias("query"))
    c = ivf.cells(n, 6)
    every = ivf.nearest(asked, ivf.indexed(n, c), c, 5, len(c))
    truth = search.nearest_of_many(asked, n, 5)
    key = lambda df: sorted((r.query_id, r.rank, r.news_id) for r in df.collect())
    assert key(every) == key(truth)
    assert ivf.recall(every, truth).first().recall == 1.0


def test_ties_of_neighbours_go_by_id(spark):
    n = spark.createDataFrame([(f"{i:03d}", [1.0, 0.0]) for i in reversed(range(100))], "news_id string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<double>")
    assert [r.news_id for r in search.nearest_of_many(asked, n, 3).orderBy("rank").collect()] == ["000", "001", "002"]


def test_encoder_makes_its_model_once_in_a_task(spark):
    df = spark.createDataFrame([("1", "aab"), ("2", None), ("3", "zz")], "news_id string, model_text string").coalesce(1)
    by = {r.news_id: r.embedding for r in encoders.encoded(df, encoders.letters, batch=2).collect()}
    assert by["1"][:2] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and by["2"] == [0.0] * 26 and by["3"][25] == 1.0


def test_preferred_member(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("other.csv", "news_id,label\n1,minor\n")
        z.writestr("in/labels.csv", "news_id,label\n2,significant\n")
    (tmp_path / "a.zip").write_bytes(box.getvalue())
    (tmp_path / "b.csv").write_text("news_id,label\n3,duplicate\n")
    assert sorted((r.news_id, r.label) for r in readers.labels(spark, str(tmp_path)).collect()) == [("2", "significant"), ("3", "duplicate")]


def test_import_job_stops_at_a_bad_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("title,text\na,b\n")
    told = []
    with pytest.raises(Exception, match="lacks title, text or a date"):
        jobs.import_job(spark, "article_csv", str(tmp_path), None, lambda *x: told.append(x))
    assert [x[0] for x in told] == ["reading"]


def test_transitions(spark):
    old = spark.createDataFrame([(1, "a", 0.2, "b"), (2, "a", 0.5, "a"), (3, "b", 0.1, "b")], "id int, label string, p double, truth string")
    new = spark.createDataFrame([(1, "b", 0.6), (2, "b", 0.4), (4, "a", 1.0)], "id int, label string, p double")
    assert sorted((r.id, r.transition, round(r.delta, 3), r.fixed, r.broken) for r in metrics.transitions(old, new, "id").collect()) == [(1, "a -> b", 0.4, True, False), (2, "a -> b", -0.1, False, True)]


@pytest.mark.parametrize("batch,hub", [(1 << 20, 1000), (40, 7)])
def test_components_in_rounds_and_at_once(spark, monkeypatch, batch, hub):
    """Chains, a hub and a tree, finished in one contraction or by rounds with spread hubs."""
    monkeypatch.setattr(C, "BATCH", batch)
    monkeypatch.setattr(C, "HUB", hub)
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300 + i, 300 + int(rng.integers(0, i))) for i in range(1, 50)] + [(5, 5)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {i: 300 for i in range(300, 350)}


def test_features_do_not_depend_on_blocks(spark, monkeypatch):
    """Stories of one block, and cut into blocks of two rows, give the same features."""
    from newsloom.operators import features as W

    n = news(spark, SF)
    stories = n.select("row_pos", (F.col("row_pos") % 9).alias("cluster"))
    plain = lambda: sorted([(r.row_pos, *[round(float(r[c]), 9) for c in W.COLUMNS], r.best_previous) for r in W.previous_only(n, stories).collect()])
    whole = plain()
    monkeypatch.setattr(W, "BLOCK", 2)
    assert plain() == whole and len(whole) == n.count()
    by = {r.row_pos: r for r in n.withColumn("c", F.col("row_pos") % 9).collect()}
    units = {k: np.array(r.embedding) / np.linalg.norm(r.embedding) for k, r in by.items()}
    at = W.COLUMNS.index("max_prev_similarity") + 1
    for row in whole:
        earlier = [k for k, r in by.items() if r.c == by[row[0]].c and (r.published_at, k) < (by[row[0]].published_at, row[0])]
        assert row[at] == pytest.approx(max((units[k] @ units[row[0]] for k in earlier), default=0.0), abs=1e-8)
