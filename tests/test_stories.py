"""Hand-made rows through joins, components, the second pass, features, summaries and metrics."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom.operators import attach as A
from newsloom.operators import components as C
from newsloom.operators import features as W
from newsloom.operators import ledger as L
from newsloom.operators import metrics as M
from newsloom.operators import novelty as N
from newsloom.operators import pairs as P
from newsloom.operators import prepare as R
from newsloom.operators import search as S
from newsloom.operators import summary as Y


def frame(spark, rows):
    """(id, day, vector, title, topic)."""
    return spark.createDataFrame([(str(i), n, d, t, t, k, v) for n, (i, d, v, t, k) in enumerate(rows)], "news_id string, row_pos long, day string, title string, text string, topic string, embedding array<double>").withColumn("published_at", F.col("day").cast("timestamp"))


def clusters(spark, rows):
    c = A.baseline(frame(spark, rows)).collect()
    return {r.news_id: r.component for r in c}


def test_baseline_edge_and_alignment(spark):
    got = clusters(spark, [("new-2", "2024-01-02", [0.9, 0.1], "b", "x"), ("new-1", "2024-01-01", [1.0, 0.0], "a", "x")])
    assert len(set(got.values())) == 1


def test_topics_are_isolated(spark):
    got = clusters(spark, [("a", "2024-01-01", [1.0, 0.0], "t", "economy"), ("b", "2024-01-01", [1.0, 0.0], "t", "politics")])
    assert len(set(got.values())) == 2


def test_window_is_inclusive(spark):
    rows = [("a", "2024-01-01", [1.0, 0.0], "t", "x"), ("b", "2024-01-15", [1.0, 0.0], "t", "x"), ("c", "2024-01-29 00:00:00.000001", [1.0, 0.0], "t", "x")]
    assert len(set(clusters(spark, rows).values())) == 2


def test_bucketed_join_meets_each_pair_once(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", [1.0, i / 50], "t", "x") for i in range(60)]
    df = frame(spark, rows)
    got = [(r.left_row_pos, r.right_row_pos) for r in P.in_band(df, 3, []).collect()]
    t = {r.row_pos: r.published_at for r in df.collect()}
    want = {(a, b) for a in t for b in t if (t[a], a) < (t[b], b) and (t[b] - t[a]).total_seconds() <= 3 * 86400}
    assert len(got) == len(set(got)) and set(got) == want


def test_attach_with_evidence(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.78, 0.625779]]
    df = frame(spark, [(i, f"2024-01-0{i + 1}", v[i], f"growth of 12 percent {i}", "x") for i in range(3)])
    base = A.baseline(df)
    assert base.select("component").distinct().count() == 2
    pairs = P.candidate_pairs(df)
    out = {r.row_pos: r for r in A.attached(base, A.selection(pairs, base)).collect()}
    assert {r.cluster for r in out.values()} == {0}
    assert out[2].assignment_method == "attach" and out[2].assignment_similarity > 0.75
    none = A.selection(P.candidate_pairs(df.withColumn("title", F.lit("")).withColumn("text", F.lit(""))), base)
    assert none.count() == 0


def test_attach_margin(spark):
    df = spark.createDataFrame([(0, "0", 0), (1, "1", 0), (2, "2", 2), (3, "3", 2), (4, "4", 4)], "row_pos long, news_id string, component long")
    p = spark.createDataFrame([(0, 4, "0", "4", 0.80, 1.0, 1.0, 1.0, 1), (2, 4, "2", "4", 0.79, 1.0, 1.0, 1.0, 1)], "left_row_pos long, right_row_pos long, left_news_id string, right_news_id string, similarity double, days_diff double, title_jaccard double, text_jaccard double, shared_numbers_count long")
    assert A.selection(p, df).count() == 0
    got = A.selection(p, df, margin=0.005).collect()
    assert [(r.source, r.target) for r in got] == [(4, 0)] and got[0].margin == pytest.approx(0.01)


@pytest.mark.parametrize("n", [2, 50, 200])
def test_components_of_chains_and_stars(spark, n):
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 4000)]
    e = spark.createDataFrame(chain, "a long, b long")
    got = {r.id: r.component for r in C.components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n)} | {4000: 4000, 5000: 4000}


def test_ranks_are_dense(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    got = [r["rank"] for r in C.ranked(df, F.col("x")).orderBy("x").collect()]
    assert got == list(range(1000))


def test_previous_only_features(spark):
    df = frame(spark, [(0, "2024-01-01", [1.0, 0.0], "rate 5 up", "x"), (1, "2024-01-02", [0.6, 0.8], "rate 5 and 7", "x"), (2, "2024-01-04", [0.0, 1.0], "other", "x")])
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "row_pos long, cluster long")
    got = {r.row_pos: r for r in W.previous_only(df, c).collect()}
    assert (got[0].days_since_previous, got[0].previous_centroid_distance, got[0].new_numbers_count) == (-1.0, 1.0, 1)
    assert got[1].max_prev_similarity == pytest.approx(0.6) and got[1].shared_numbers_count == 1 and got[1].new_numbers_count == 1
    assert got[2].top2_mean_similarity == pytest.approx(0.4) and got[2].last_prev_similarity == pytest.approx(0.8)
    centre = (1.6 / 2, 0.8 / 2)
    assert got[2].previous_centroid_similarity == pytest.approx(centre[1] / (centre[0] ** 2 + centre[1] ** 2) ** 0.5)
    assert got[2].days_since_cluster_start == 3.0


def test_a_large_cluster_is_sent_a_few_times(spark, monkeypatch):
    """Rows sent grow with the table, and small blocks and pieces give the same features."""
    n = 3000
    rows = spark.range(n).selectExpr("0L AS cluster", "CAST(id AS INT) AS pos", "id AS row_pos", "array(1.0D, id / 10) AS unit", "array('a', CAST(id % 7 AS STRING)) AS title_tokens", "transform(sequence(0, 40), i -> CAST(i * id % 97 AS STRING)) AS text_tokens")
    assert W._sent(rows).count() <= (W.PARTS + 1) * n
    few = rows.where("pos < 60").withColumn("text_tokens", F.array_distinct("text_tokens"))
    plain = lambda: sorted((r.row_pos, r.n, round(r.total, 9), r.tj, r.xj, [round(x, 9) for x in r.tops]) for r in W._previous(few).groupBy("row_pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("tj").alias("tj"), F.max("xj").alias("xj"), F.slice(F.sort_array(F.flatten(F.collect_list("tops")), False), 1, 3).alias("tops")).collect())
    want = plain()
    own = {r.pos: r for r in few.collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert [(r[0], r[1], r[4]) for r in want] == [(i, i, max(jaccard(own[i].text_tokens, own[j].text_tokens) for j in range(i))) for i in range(1, 60)]
    for name, value in {"LEAST": 600, "MOST": 900, "BLOCK": 3, "PIECE": 5}.items():
        monkeypatch.setattr(W, name, value)
    assert plain() == want


def test_pairs_of_small_clusters_are_enough(spark):
    rows = [(i, f"2024-01-{1 + i % 9:02d}", [1.0, (i * 7 % 11) / 4], f"growth {i % 3}", "x") for i in range(40)]
    df = frame(spark, rows)
    base = A.baseline(df, 0.9995, 14)
    all_, few = P.candidate_pairs(df, 0.9, 7), P.candidate_pairs(df, 0.9, 7, A.sources(base))
    plain = lambda p: sorted(map(tuple, A.selection(p, base, 0.9, margin=0.0).collect()))
    assert plain(all_) == plain(few) and few.count() < all_.count()


@pytest.mark.parametrize("span,at_once,block", [(32, 1 << 21, 512), (2, 30, 4)])
def test_evidence_is_taken_in_the_tiles(spark, monkeypatch, span, at_once, block):
    """The same as of all pairs, and no join brings words to a pair."""
    texts = ["growth of 12 percent", "Growth, 12,5 percent and 3", None, "", "other words 3 and 12 here", "ночь и день 7"]
    rows = [(i, f"2024-01-{1 + i * 5 % 23:02d}", [1.0, (i * 7 % 11) / 4], texts[i % 6], "xy"[i % 5 == 0]) for i in range(70)]
    df = frame(spark, rows).withColumn("text", F.concat_ws(" ", "text", F.col("row_pos") % 9))
    for name, value in {"SPAN": span, "AT_ONCE": at_once, "RUN": 1000}.items():
        monkeypatch.setattr(P.tiles, name, value)
    monkeypatch.setattr(P.tiles.Join.__init__, "__defaults__", (block, False))
    own = {r.row_pos: r for r in P.vectorised(df).select("*", F.unix_micros("published_at").alias("at")).collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / max(len(set(a) | set(b)), 1)
    want = {}
    for a in own.values():
        for b in own.values():
            s = sum(x * y for x, y in zip(a.unit, b.unit, strict=True))
            if a.topic == b.topic and (a.at, a.row_pos) < (b.at, b.row_pos) and b.at - a.at <= 5 * P.DAY and s >= 0.9:
                want[a.row_pos, b.row_pos] = (a.news_id, b.news_id, a.topic, round(s, 9), round((b.at - a.at) / P.DAY, 9), jaccard(a.title_tokens, b.title_tokens), jaccard(a.text_tokens, b.text_tokens), len(set(a.numbers) & set(b.numbers)))
    plain = lambda p: {(r[0], r[1]): (*r[2:5], round(r[5], 9), round(r[6], 9), *r[7:]) for r in p.collect()}
    pairs = P.candidate_pairs(df, 0.9, 5)
    assert plain(pairs) == want and len(want) > 100
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    few = plain(P.candidate_pairs(df, 0.9, 5, df.where("row_pos % 7 = 0")))
    both = want | {(b, a): (v[1], v[0], *v[2:]) for (a, b), v in want.items()}
    assert few == {k: v for k, v in both.items() if k[0] % 7 == 0}


def test_labels(spark):
    f = spark.createDataFrame([(0, 0, 0, 0.0), (1, 0, 1, 0.95), (2, 0, 2, 0.5)], "row_pos long, cluster long, position_in_cluster long, max_prev_similarity double")
    got = {r.row_pos: r for r in N.labelled(f, F.when(F.col("row_pos") == 2, 0.45).otherwise(0.1)).collect()}
    assert [got[i].novelty_label for i in range(3)] == ["significant", "duplicate", "significant"]
    assert got[0].p_significant == 1.0 and not got[0].needs_review and got[2].needs_review
    assert got[0].comment.startswith("cluster seed") and got[1].comment == "p_significant=0.1000; max_prev_similarity=0.9500"


def test_medoid(spark):
    df = frame(spark, [(0, "2024-01-01", [1.0, 0.0], "a", "x"), (1, "2024-01-02", [0.8, 0.6], "b", "x"), (2, "2024-01-03", [0.0, 1.0], "c", "x")]).withColumn("cluster", F.lit(1)).withColumn("novelty_label", F.lit("minor"))
    r = Y.summaries(df, ["cluster"]).first()
    assert (r.representative_article_id, r.article_count, str(r.started_at.date()), str(r.last_seen_at.date())) == ("1", 3, "2024-01-01", "2024-01-03")


def test_structure_metrics(spark):
    df = spark.createDataFrame(list(zip("aaabb", "xxyzz", strict=True)), "r string, p string")
    s = M.structure(df, "r", "p").first()
    assert (s.split_full, s.fragmented_rate, s.split_incremental) == (1, 0.5, 0)
    assert M.pairwise(df, "r", "p").first().precision == 1.0


def test_metric_goldens(spark):
    names = ["significant", "minor", "duplicate", "unclear"]
    table = [[13, 33, 6], [0, 8, 0], [0, 4, 1], [1, 0, 0]]
    rows = [(names[i], names[j], n) for i, r in enumerate(table) for j, n in enumerate(r) if n]
    m = M.multiclass(spark.createDataFrame(rows, "truth string, guess string, n long")).first()
    assert (round(m.accuracy, 4), round(m.cohen_kappa, 4)) == (0.3333, 0.1018)
    tn, fp, fn, tp = 3, 11, 11, 62
    b = spark.createDataFrame([(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp, "t int, g int")
    r = M.binary(b, F.col("t"), F.col("g")).first()
    assert round(r.precision, 4) == round(r.recall, 4) == round(r.f1, 4) == 0.8493


def test_upsert_and_ledger(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id int, x double")
    b = spark.createDataFrame([(2, 0.8), (3, 0.3)], "id int, x double")
    assert sorted(map(tuple, L.upserted(a, b, ["id"]).collect())) == [(1, 0.1), (2, 0.8), (3, 0.3)]
    t = spark.createDataFrame([("a", "o", None, 1, 10), ("b", "o", "k", 2, -15), ("c", "o", "k", 3, 7)], "id string, organization_id string, batch_id string, timestamp int, amount int")
    assert [(r.balance_after, r.allowed) for r in L.running(t).orderBy("timestamp").collect()] == [(10, True), (-5, False), (2, True)]
    assert sorted((r.group_id, r.amount, r["items"]) for r in L.grouped(t).collect()) == [("a", 10, 1), ("k", -8, 2)]


def test_lifecycle_is_all_or_nothing(spark):
    a = spark.createDataFrame([("1", "draft", "not_started"), ("2", "public", "processed")], "news_id string, visibility string, status string")
    ask = lambda *x: spark.createDataFrame([(i,) for i in x], "news_id string")
    out, bad = L.changed(ask("1", "2"), a, L.may_publish(), {"visibility": F.lit("public")})
    assert [r.news_id for r in bad.collect()] == ["2"] and sorted(r.visibility for r in out.collect()) == ["draft", "public"]
    out, bad = L.changed(ask("1"), a, L.may_publish(), {"visibility": F.lit("public")})
    assert bad.count() == 0 and {r.visibility for r in out.collect()} == {"public"}


def test_relevance_is_cut_after_the_limit(spark):
    rows = [(0, "2024-01-01", [1.0, 0.0], "a", "x"), (1, "2024-01-02", [0.9, 0.43589], "b", "x")]
    a = frame(spark, rows).withColumns({"status": F.lit("processed"), "visibility": F.lit("public"), "organization_id": F.lit("o"), "cluster_id": F.lit("c"), "novelty_label": F.lit("minor")})
    none = spark.createDataFrame([], "organization_id string, cluster_id string, representative_article_id string, representative_title string, article_count long, started_at timestamp, last_seen_at timestamp")
    clusters, items = S.search(a, none, [1.0, 0.0], 5, min_relevance=0.95)
    got = {r.news_id: r.score for r in items.collect()}
    assert got["0"] == pytest.approx(1.0) and got["1"] is None
    assert clusters.first().article_count == 2


def test_prepare(spark):
    df = spark.createDataFrame([(" 12.0 ", "2024-01-01", None, "t")], "news_id string, published_at string, title string, text string")
    r = R.prepared(df).first()
    assert (r.news_id, r.title, r.topic, r.model_text) == ("12", "", "<missing>", "\n\nt")
    with pytest.raises(PySparkException):
        R.prepared(df.withColumn("published_at", F.lit("never"))).collect()
    with pytest.raises(ValueError):
        R.prepared(df.drop("title"))
    assert R.clean_like(df.withColumn("published_at", F.lit("never"))).count() == 0
