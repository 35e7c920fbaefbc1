"""Incremental assignment, replay, streams and import files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from newsloom.sources import readers, sinks
from newsloom.streaming import incremental as I
from newsloom.streaming import replay, stream

NEW = "news_id string, topic string, day string, title string, text string, embedding array<double>"


def history(spark, rows):
    """(id, day, vector, cluster, component, title, method, parent, similarity, attached_to)."""
    full = [(i, "x", d, t, t, v, c, k, *(more or ("baseline", None, None, None))) for i, d, v, c, k, t, *more in rows]
    df = spark.createDataFrame(full, NEW + ", cluster_id string, component_id string, assignment_method string, assignment_parent_news_id string, assignment_similarity double, attached_to_component_id string")
    return df.withColumn("published_at", F.col("day").cast("timestamp")).drop("day")


def fresh(spark, rows):
    df = spark.createDataFrame([(i, k[0] if k else "x", d, t, t, v) for i, d, v, t, *k in rows], NEW)
    return df.withColumn("published_at", F.col("day").cast("timestamp")).drop("day")


def run(spark, old, new):
    return {r.news_id: r for r in I.assigned(history(spark, old), fresh(spark, new)).collect()}


def test_strong(spark):
    r = run(spark, [("o", "2024-01-01", [1.0, 0.0], "event-1", "base-1", "t")], [("n", "2024-01-02", [0.9, 0.1], "t")])["n"]
    assert (r.cluster_id, r.assignment_method, r.component_id) == ("event-1", "baseline", "base-1")


def test_attach(spark):
    r = run(spark, [("o", "2024-01-01", [1.0, 0.0], "event-1", "base-1", "up 12 percent")], [("n", "2024-01-03", [0.78, 0.625779], "up 12 percent")])["n"]
    assert (r.cluster_id, r.assignment_method, r.attached_to_component_id) == ("event-1", "attach", "base-1") and r.component_id.startswith("incremental_base_")


def test_ambiguity_opens_a_cluster(spark):
    old = [("a", "2024-01-01", [1.0, 0.0, 0.0], "e1", "b1", "up 12"), ("b", "2024-01-01", [0.0, 1.0, 0.0], "e2", "b2", "up 12")]
    r = run(spark, old, [("n", "2024-01-02", [0.7071, 0.7071, 0.0], "up 12")])["n"]
    assert r.update_method == "new_cluster"
    old = [("a", "2024-01-01", [0.77, 0.638, 0.0], "e1", "b1", "up 12"), ("b", "2024-01-01", [0.76, -0.65, 0.0], "e2", "b2", "up 12")]
    r = run(spark, old, [("n", "2024-01-02", [1.0, 0.0, 0.0], "up 12")])["n"]
    assert r.update_method == "new_cluster_ambiguous" and r.assignment_needs_review and r.cluster_id not in ("e1", "e2")


def test_bridge_merges_and_keeps_provenance(spark):
    old = [("old-1", "2024-01-01", [1.0, 0.0], "e1", "b1", "t"), ("old-2", "2024-01-01", [0.9, 0.43589], "e2", "b2", "t", "attach", "parent-2", 0.78, "base-parent")]
    got = run(spark, old, [("new-1", "2024-01-02", [0.99, 0.14], "t")])
    assert got["new-1"].update_method == "baseline_merge" and set(got) == {"new-1", "old-2"} and set(got["new-1"].affected) == {"old-1", "old-2"}
    moved = got["old-2"]
    assert (moved.update_method, moved.cluster_id, moved.previous_cluster_id) == ("cluster_merge", "e1", "e2")
    assert (moved.assignment_method, moved.assignment_parent_news_id, moved.assignment_similarity, moved.attached_to_component_id) == ("attach", "parent-2", 0.78, "base-parent")


def test_merge_within_a_batch(spark):
    new = [("1", "2024-01-01", [0.84, 0.542586, 0.0], "t"), ("2", "2024-01-02", [0.84, -0.542586, 0.0], "t"), ("3", "2024-01-03", [1.0, 0.0, 0.0], "t")]
    got = run(spark, [], new)
    assert len({r.cluster_id for r in got.values()}) == 1 and got["3"].update_method == "baseline_merge"


def test_chronology(spark):
    got = run(spark, [], [("2", "2024-01-02", [0.9, 0.1], "t"), ("1", "2024-01-01", [1.0, 0.0], "t")])
    assert (got["1"].update_method, got["2"].update_method) == ("new_cluster", "baseline")


def test_late_arrival(spark):
    old = [("past", "2024-01-01", [0.0, 1.0], "e1", "b1", "t"), ("future", "2024-01-10", [1.0, 0.0], "e1", "b1", "t")]
    r = run(spark, old, [("late", "2024-01-05", [1.0, 0.0], "t")])["late"]
    assert (r.cluster_id, r.late_arrival, r.affected_historical_count, r.affected) == ("e1", True, 1, ["future"])
    old = [("future", "2024-01-10", [1.0, 0.0], "e1", "b1", "t")]
    assert not run(spark, old, [("n", "2024-01-05", [1.0, 0.0], "t", "other")])["n"].late_arrival


def test_a_row_affected_twice_is_named_once(spark):
    old = [("past", "2024-01-01", [0.0, 1.0], "e1", "b1", "t"), ("future", "2024-01-10", [1.0, 0.0], "e1", "b1", "t"), ("last", "2024-01-11", [1.0, 0.0], "e1", "b1", "t")]
    got = run(spark, old, [(f"late-{d}", f"2024-01-0{d}", [1.0, 0.0], "t") for d in (4, 5, 6)])
    assert [(got[f"late-{d}"].affected_historical_count, got[f"late-{d}"].affected) for d in (4, 5, 6)] == [(2, ["future", "last"]), (2, []), (2, [])]


def test_checked(spark):
    h = history(spark, [("o", "2024-01-01", [1.0, 0.0], "e", "b", "t")])
    with pytest.raises(ValueError):
        I.checked(h, fresh(spark, [("o", "2024-01-02", [1.0, 0.0], "t")]))
    with pytest.raises(ValueError):
        I.checked(h, fresh(spark, [("n", "2024-01-02", [1.0, 0.0], "t")] * 2))
    I.checked(h, fresh(spark, [("n", "2024-01-02", [1.0, 0.0], "t")]))


def test_replay_without_attach_equals_full(spark):
    import math

    rows = [(str(i), f"2024-01-{1 + i:02d}", [math.cos(i // 6), math.sin(i // 6)], f"word{i}") for i in range(30)]
    df = fresh(spark, rows).withColumn("row_pos", F.col("news_id").cast("long"))
    out = replay.replay(df, I.Config(attach=0.99))
    assert len(out) == 3 and all(m.precision == m.recall == 1.0 for *_, m in out)


def test_stream_assigns_batches(spark, tmp_path):
    rows = [("1", "2024-01-01", [1.0, 0.0], "t"), ("2", "2024-01-02", [0.9, 0.1], "t"), ("3", "2024-01-03", [0.0, 1.0], "t")]
    for i, r in enumerate(rows):
        fresh(spark, [r]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    schema = fresh(spark, rows).schema
    articles = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    state = stream.StateTable(spark, str(tmp_path / "state"), stream.STATE_SCHEMA)
    stream.assign(articles, state, str(tmp_path / "ck")).awaitTermination()
    got = {r.news_id: r.cluster_id for r in state.read().collect()}
    assert len(got) == 3 and got["1"] == got["2"] != got["3"]


def test_job_queue_records_failures(spark, tmp_path):
    sinks.messages(spark.createDataFrame([("full", "j1"), ("search", "j2")], "type string, job_id string"), str(tmp_path / "q"))

    def fail(batch, n):
        raise RuntimeError("no model")

    log = stream.StateTable(spark, str(tmp_path / "log"), stream.JOBS_SCHEMA)
    stream.jobs(readers.queue(spark, str(tmp_path / "q")), {"full": lambda b, n: b.count(), "search": fail}, log, str(tmp_path / "ck")).awaitTermination()
    assert {r.job_id: (r.status, r.error) for r in log.read().collect()} == {"j1": ("done", None), "j2": ("failed", "no model")}


def test_windowed_event_counts(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "e"))
    src = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = stream.event_counts(src).writeStream.outputMode("complete").format("memory").queryName("event_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("event_counts").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "e")).count()


def test_import_files(spark, tmp_path):
    good = 'title,text,date,tags\nA,body,2020/01/02,x\n"B ""q""","two\nlines",2020-01-03,\n,no title,2020-01-01,\nC,body,never,\n'
    (tmp_path / "a.csv").write_bytes("﻿".encode() + good.encode())
    with zipfile.ZipFile(tmp_path / "b.ZIP", "w") as z:
        z.writestr("in.CSV", "title,text,published_at,language\nЗаголовок,текст,2020-01-01T12:30:00+03:00,en\n".encode("cp1251"))
        z.writestr("readme.txt", "x")
    ok, bad = readers.imported(readers.import_files(spark, str(tmp_path)))
    got = {r.title: r for r in ok.collect()}
    assert set(got) == {"A", 'B "q"', "Заголовок"}
    assert str(got["A"].published_at) == "2020-01-02 00:00:00" and got["A"].language == "ru" and got["A"].metadata == '{"tags":"x"}'
    assert str(got["Заголовок"].published_at) == "2020-01-01 09:30:00" and got["Заголовок"].language == "en"
    assert sorted(r.error for r in bad.collect()) == ["the date can't be read", "the title is blank"]
    with pytest.raises(readers.BadImport):
        readers.imported(readers.import_files(spark, str(tmp_path)), max_rows=2)
    with pytest.raises(readers.BadImport):
        readers.read(spark, "unknown", "")
    with pytest.raises(readers.BadImport):
        list(readers.members("x.zip", (tmp_path / "b.ZIP").read_bytes()[:0] or _empty_zip(tmp_path)))


def _empty_zip(tmp_path):
    with zipfile.ZipFile(tmp_path / "e.bin", "w") as z:
        z.writestr("a.txt", "x")
    return (tmp_path / "e.bin").read_bytes()


def test_state_writes(spark):
    a = spark.createDataFrame([("1", "pending", None, '{"pipeline_error":"x","k":"1"}'), ("2", "pending", 0.5, None)], "news_id string, status string, novelty_score double, metadata string")
    r = spark.createDataFrame([("1", 0.7)], "news_id string, p_significant double")
    got = {x.news_id: x for x in sinks.article_status(a, r).collect()}
    assert (got["1"].status, got["1"].novelty_score, got["1"].metadata) == ("processed", 0.7, '{"k":"1"}') and got["2"].status == "pending"
    bad = {x.news_id: x for x in sinks.failed(a, r, "boom").collect()}
    assert bad["1"].status == "error" and '"pipeline_error":"boom"' in bad["1"].metadata


def test_vectors_align_or_fail(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "news_id string")
    cache = spark.createDataFrame([("1", [1.0])], "news_id string, embedding array<double>")
    with pytest.raises(Exception, match="no vector for 2"):
        readers.aligned(ids, cache).collect()
    docs = ids.withColumn("text", F.lit("a b c"))
    full = readers.completed(docs, cache, lambda d: readers.hashed_vectors(d, 8))
    assert {r.news_id: len(r.embedding) for r in readers.aligned(ids, full).collect()} == {"1": 1, "2": 8}


def test_csv_and_batches(spark, tmp_path):
    (tmp_path / "n.csv").write_text("url,title,text,topic,tags,date\nu,T,x,a,,2019/12/31\n")
    r = readers.dated(readers.csv_table(spark, str(tmp_path / "n.csv"))).first()
    assert str(r.published_at) == "2019-12-31 00:00:00"
    sinks.in_batches(spark.range(250), str(tmp_path / "out"), 100, F.col("id"))
    assert {x.batch: x["count"] for x in spark.read.json(str(tmp_path / "out")).groupBy("batch").count().collect()} == {0: 100, 1: 100, 2: 50}
    sinks.predictions(spark.createDataFrame([("1", "2024-01-01 01:02:03")], "news_id string, at string").withColumn("at", F.col("at").cast("timestamp")), str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).first()["at"] == "2024-01-01 01:02:03"


def test_state_table_goes_on_after_a_restart(spark, tmp_path):
    rows = [("1", "2024-01-01", [1.0, 0.0], "t"), ("2", "2024-01-02", [0.9, 0.1], "t"), ("3", "2024-01-03", [0.0, 1.0], "t"), ("4", "2024-01-04", [0.1, 0.9], "t")]
    schema = fresh(spark, rows).schema

    def go(part):
        for r in part:
            fresh(spark, [r]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={r[0]}"))
        articles = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        state = stream.StateTable(spark, str(tmp_path / "state"), stream.STATE_SCHEMA)
        stream.assign(articles, state, str(tmp_path / "ck")).awaitTermination()
        return {r.news_id: r.cluster_id for r in stream.StateTable(spark, str(tmp_path / "state"), stream.STATE_SCHEMA).read().collect()}

    first = go(rows[:2])
    assert set(first) == {"1", "2"}
    got = go(rows[2:])
    assert len(got) == 4 and got["1"] == got["2"] == first["1"] and got["3"] == got["4"] != got["1"]
    (tmp_path / "state" / "v=9").mkdir()  # a batch that never ended does not count
    assert stream.StateTable(spark, str(tmp_path / "state"), stream.STATE_SCHEMA).read().count() == 4


def test_keyed_stream_equals_the_batch_and_restarts(spark, tmp_path):
    import math
    import random

    from newsloom.streaming import keyed

    rng = random.Random(5)
    rows = []
    for i in range(160):
        day, angle = i * 60 // 160, rng.choice([0.0, 0.55, 1.1, 2.0]) + rng.uniform(-0.25, 0.25)
        at = f"2024-{1 + day // 30:02d}-{1 + day % 30 - (2 if day // 30 == 1 and day % 30 > 27 else 0):02d} {i % 24:02d}:00:00"
        rows.append((str(i), at, [math.cos(angle), math.sin(angle)], f"word{rng.randint(0, 5)} and {rng.randint(1, 9)}", rng.choice("ab")))
    rows.sort(key=lambda r: (r[1], int(r[0])))
    config = I.Config(strong=0.97, attach=0.9)
    full = {r.news_id: r for r in I.assigned(history(spark, []), fresh(spark, rows), config).collect()}
    schema, parts = fresh(spark, rows).schema, [rows[a : a + 20] for a in range(0, 160, 20)]

    def go(some, at):
        for k, part in enumerate(some, at):
            fresh(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
        articles = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        keyed.started(articles, str(tmp_path / "out"), str(tmp_path / "ck"), config, "30 days").awaitTermination()

    go(parts[:3], 0)
    go(parts[3:], 3)
    result = spark.read.parquet(str(tmp_path / "out"))
    got = {r.news_id: r for r in keyed.current(result).collect()}
    assert len(got) == 160
    assert sum(len(r.merged_cluster_ids) > 1 for r in full.values()) > 2
    full = {i: r for i, r in full.items() if r.update_method != "cluster_merge"}
    for i, r in full.items():
        assert (r.cluster_id, r.component_id, r.update_method, r.late_arrival) == (got[i].cluster_id, got[i].component_id, got[i].update_method, got[i].late_arrival)

    # With a short watermark stories close, once each and with all their rows, and rows out of the window are gone.
    keyed.started(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), str(tmp_path / "out2"), str(tmp_path / "ck2"), I.Config(strong=0.97, attach=0.9, days=5), "1 hour").awaitTermination()
    result = spark.read.parquet(str(tmp_path / "out2"))
    sizes = {(r.topic, r.cluster_id): r["count"] for r in keyed.current(result).groupBy("topic", "cluster_id").count().collect()}
    closed = result.where("kind = 'closed'").collect()
    assert closed and len({(r.topic, r.cluster_id) for r in closed}) == len(closed)
    assert all(sizes[r.topic, r.cluster_id] == r.size for r in closed)
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck2")).option("stateVarName", "rows").load()
    assert state.count() < 60


def test_queue_retries_and_keeps_dead_letters(spark, tmp_path):
    from newsloom.streaming import metrics, queue

    calls = []

    def flaky(batch, n):
        calls.append(sorted(r.job_id for r in batch.collect()))
        if len(calls) == 1:
            raise RuntimeError("try again")

    def broken(batch, n):
        raise RuntimeError("never")

    rows = [("full", f"f{i}") for i in range(20)] + [("flaky", "a"), ("flaky", "b"), ("broken", "c"), ("odd", "d"), (None, "e")]
    messages = spark.createDataFrame(rows, "type string, job_id string")
    with metrics.Meter(spark, str(tmp_path / "m")) as meter:
        first = queue.JobQueue(spark, str(tmp_path / "q"), {"full": lambda b, n: b.count(), "flaky": flaky, "broken": broken}, attempts=2, meter=meter)
        first.publish(messages.repartition(3))
        assert len(list((tmp_path / "q" / "in").glob("part-*"))) > 1
        first.start().awaitTermination()
        assert {r.job_id: r.status for r in first.status().collect()} | {"a": "failed"} == {r.job_id: r.status for r in first.status().collect()}
        again = queue.JobQueue(spark, str(tmp_path / "q"), first.handlers, attempts=2, meter=meter)  # restarted: goes on from its folder
        again.drain()
    got = {r.job_id: (r.status, r.attempts) for r in again.status().collect()}
    assert got == {**{f"f{i}": ("done", 1) for i in range(20)}, "a": ("done", 2), "b": ("done", 2), "c": ("failed", 2), "d": ("unknown", 1), "e": ("unknown", 1)}
    assert calls == [["a", "b"], ["a", "b"]]
    assert {(r.job_id, r.error) for r in again.dead().collect()} == {("c", "never"), ("d", "no handler"), ("e", "no handler")}
    again.drain()  # nothing waits
    assert again.log().count() == 20 + 4 + 2 + 2
    counted = {(r["mode"], r.status): (r.jobs, r.articles) for r in metrics.counters(meter.jobs()).collect()}
    assert counted == {("full", "done"): (1, 20), ("flaky", "failed"): (1, 0), ("flaky", "done"): (1, 2), ("broken", "failed"): (2, 0)}
    seen = {r.metric: r.n for r in meter.observed().groupBy("metric").agg(F.sum("value").alias("n")).collect()}
    assert seen == {"all": 25 + 3, "full": 20, "flaky": 4, "broken": 2}
    assert {r.le: r.n for r in metrics.buckets(meter.jobs()).where("mode = 'broken'").collect()}[float("inf")] == 2
    assert {r["mode"]: r.last_status for r in metrics.gauges(meter.jobs()).collect()} == {"full": "done", "flaky": "done", "broken": "failed"}


def test_timed_batch_jobs(spark, tmp_path):
    from newsloom.streaming import metrics

    meter = metrics.Meter(spark, str(tmp_path / "m"))
    assert meter.timed("full", spark.range(70), lambda df: df.collect()[-1].id) == 69
    with pytest.raises(ZeroDivisionError):
        meter.timed("full", spark.range(5), lambda df: 1 / 0)
    meter.flush()
    assert sorted((r.status, r.rows) for r in meter.jobs().collect()) == [("done", 70), ("failed", 0)]


def test_article_files_as_a_data_source(spark, tmp_path):
    from newsloom.sources import archives

    long = "word " * 60_000
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_bytes("﻿".encode() + f'title,text,date,extra\nA,"{long}",2020/01/02,x\n"B ""q""","two\nlines",2020-01-03,\nshort\n'.encode())
    with zipfile.ZipFile(tmp_path / "in" / "sub" / "b.ZIP", "w") as z:
        z.writestr("in/one.CSV", "title,text,published_at\nЗаголовок,текст,2020-01-01T12:30:00+03:00\n".encode("cp1251"))
        z.writestr("two.csv", "published_at,text,title\n2020-01-05,t,T\n")
        z.writestr("readme.txt", "x")
    df = archives.read(spark, str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() == 3
    got = {r.title: r for r in df.collect()}
    assert set(got) == {"A", 'B "q"', "short", "Заголовок", "T"}
    assert got["A"].text == long and got['B "q"'].text == "two\nlines" and got["short"].text is None and got["T"].file == "two.csv" and got["T"].line == 2
    some = archives.read(spark, str(tmp_path / "in"), "text string, title string", preferred="two.csv")
    assert some.columns == ["text", "title"] and {r.title for r in some.collect()} == {"A", 'B "q"', "short", "T"}
    (tmp_path / "bad").mkdir()
    for name, content in (("a.csv", b""), ("b.csv", b"title,body\nx,y\n"), ("c.txt", b"x")):
        for f in (tmp_path / "bad").iterdir():
            f.unlink()
        (tmp_path / "bad" / name).write_bytes(content)
        with pytest.raises(Exception, match="is empty|lacks title|no CSV"):
            archives.read(spark, str(tmp_path / "bad")).collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id AS string) title", "coalesce(text, '') text", "'2020-01-01' date")
    archives.zipped(docs.repartition(3), str(tmp_path / "z"), 40)
    back = archives.read(spark, f"file://{tmp_path}/z", "title string, text string, date string")
    assert back.rdd.getNumPartitions() >= 6 and sorted(back.collect()) == sorted(docs.collect())


def test_keyed_table_rewrites_what_it_touches(spark, tmp_path):
    from newsloom.sources.keyed import KeyedTable

    table = lambda: KeyedTable(spark, str(tmp_path / "t"), "id long, a string, b long", ["id"], 8)
    assert table().read().collect() == []
    rows = spark.range(800).selectExpr("id", "'x' a", "id * 2 b")
    table().replace(rows)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    own = F.pmod(F.xxhash64("id"), F.lit(8)) == 3
    table().upsert(rows.where(own).limit(1).selectExpr("id", "'y' a", "cast(NULL AS long) b"))
    new = set(files()) - set(before)
    assert len(new) == 1 and "bucket=3" in str(next(iter(new))) and {p: t for p, t in files().items() if p in before} == before
    assert table().read().count() == 800 and table().read().where("a = 'y' AND b IS NULL").count() == 1
    table().merge(spark.createDataFrame([(5, None, 7), (9000, "z", None)], "id long, a string, b long"))
    got = {r.id: (r.a, r.b) for r in table().read().where("id IN (5, 6, 9000)").collect()}
    assert got[6] == ("x", 12) and got[9000] == ("z", None) and got[5][1] == 7 and got[5][0] is not None
    table().delete(spark.range(100))
    assert table().read().count() == 701
    t = table()
    n = t.versions()[-1] + 1
    t.upsert(spark.createDataFrame([(7000, "q", 1)], "id long, a string, b long"), n)
    t.upsert(spark.createDataFrame([(7000, "r", 2)], "id long, a string, b long"), n)  # a batch that is run again
    assert t.read().where("id = 7000").first().a == "r" and t.read(n).count() == 701 and t.read().count() == 702
    (tmp_path / "t" / "data" / "version=99" / "bucket=1").mkdir(parents=True)  # a write that died
    assert table().read().count() == 702
    assert table().vacuum(1) > 0 and table().read().count() == 702
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(1, "q", 1), (1, "r", 1)], "id long, a string, b long"))
    t.delete(spark.range(10_000))
    assert t.read().count() == 0


def test_stream_into_a_keyed_table(spark, tmp_path):
    from newsloom.sources.keyed import KeyedTable

    rows = [("1", "2024-01-01", [1.0, 0.0], "t"), ("2", "2024-01-02", [0.9, 0.1], "t"), ("3", "2024-01-03", [0.0, 1.0], "t")]
    for i, r in enumerate(rows):
        fresh(spark, [r]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    articles = spark.readStream.schema(fresh(spark, rows).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    state = KeyedTable(spark, str(tmp_path / "state"), stream.STATE_SCHEMA, ["news_id"], 4)
    stream.assign(articles, state, str(tmp_path / "ck")).awaitTermination()
    got = {r.news_id: r.cluster_id for r in KeyedTable(spark, str(tmp_path / "state"), stream.STATE_SCHEMA, ["news_id"], 4).read().collect()}
    assert len(got) == 3 and got["1"] == got["2"] != got["3"]


def test_import_files_are_streamed(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("title,text,date\r\nX,\"one\ntwo\",2024/01/01\r\n".encode("cp1251"))
    df = readers.import_files(spark, str(tmp_path))
    assert [(r.line, r.title, r.text) for r in df.collect()] == [(2, "X", "one\ntwo")]
    assert "content:binary" not in df._jdf.queryExecution().executedPlan().toString()
