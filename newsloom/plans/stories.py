"""Queries of the story pipeline: joins, components, second pass, features, labels, summaries, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import vector as V
from newsloom.operators import attach as A
from newsloom.operators import components as C
from newsloom.operators import features as W
from newsloom.operators import lexical as X
from newsloom.operators import novelty as N
from newsloom.operators import pairs as P
from newsloom.operators import search as S
from newsloom.operators import summary as Y
from newsloom.operators import tiles
from newsloom.operators.components import materialise

from .base import CALIBRATED, clusters, edges, feature_rows, final, folder, near, news, query, r6, selected, stamp, stated

TS = "strftime({x}, '%Y-%m-%d %H:%M:%S')"


@query("SELECT a::BIGINT AS a, b::BIGINT AS b, round(sim, 6) AS similarity, round(days, 6) AS days_diff FROM edges", "edges")
def j01_band_similarity_join(spark, sf):
    return edges(spark, sf).select("a", "b", r6("similarity"), r6("days_diff"))


@query("SELECT a::BIGINT AS a, b::BIGINT AS b, topic, round(sim, 6) AS similarity, round(days, 6) AS days_diff, round(tj, 6) AS title_jaccard, round(xj, 6) AS text_jaccard, shared::BIGINT AS shared_numbers FROM pairs", "pairs")
def j02_candidate_pairs(spark, sf):
    p = P.candidate_pairs(news(spark, sf), CALIBRATED["attach"], CALIBRATED["days"])
    return p.select(F.col("left_row_pos").alias("a"), F.col("right_row_pos").alias("b"), "topic", r6("similarity"), r6("days_diff"), r6("title_jaccard"), r6("text_jaccard"), F.col("shared_numbers_count").alias("shared_numbers"))


@query("SELECT topic, count(*) AS pairs, round(max(sim), 6) AS top FROM band GROUP BY topic", "band")
def j03_pairs_in_window(spark, sf):
    n = news(spark, sf)
    p = tiles.similar(n, -2.0, 14).join(n.select(F.col("row_pos").alias("a"), "topic"), "a")
    return p.groupBy("topic").agg(F.count("*").alias("pairs"), r6(F.max("similarity"), "top"))


@query("SELECT least(a, b)::BIGINT AS a, greatest(a, b)::BIGINT AS b, round(sim, 6) AS similarity FROM band WHERE sim >= 0.22 AND days <= 7", "band")
def j04_symmetric_window_join(spark, sf):
    return P.edges(news(spark, sf), 0.22, 7).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), r6("similarity"))


@query("SELECT a::BIGINT AS a, b::BIGINT AS b, round(sim - 0.002 * days, 6) AS decayed FROM band WHERE sim - 0.002 * days >= 0.25", "band")
def j05_time_decayed_join(spark, sf):
    e = P.edges(news(spark, sf), 0.25, 14, score=lambda s, d: s - 0.002 * d)
    return e.select("a", "b", r6(F.col("similarity") - 0.002 * F.col("days_diff"), "decayed"))


@query("SELECT x.a::BIGINT AS a, x.b::BIGINT AS b, round(x.sim, 6) AS similarity FROM top x JOIN top y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b", "edges", "both_ways AS (SELECT a, b, sim FROM edges UNION ALL SELECT b, a, sim FROM edges), top AS (SELECT * FROM both_ways QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 3)")
def j06_mutual_neighbours(spark, sf):
    return P.mutual_neighbours(news(spark, sf), 3, 14, CALIBRATED["strong"]).select("a", "b", r6("similarity"))


_TFIDF = """words AS (SELECT row_pos AS id, regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9]+') AS w FROM news),
terms AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM news)),
raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM news)) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs USING (term)), nrm AS (SELECT id, sqrt(sum(w * w)) AS n FROM raw GROUP BY 1), wts AS (SELECT id, term, raw.w / n AS w FROM raw JOIN nrm USING (id))"""


def _weights(spark, sf):
    return X.weights(news(spark, sf).select(F.col("row_pos").alias("id"), "text"), "id", "text", min_df=2, max_share=0.9)


@query("SELECT id::BIGINT AS id, count(*) AS terms, round(max(w), 6) AS top FROM wts GROUP BY id", "news", _TFIDF)
def v08_tfidf_weights(spark, sf):
    return _weights(spark, sf).groupBy("id").agg(F.count("*").alias("terms"), r6(F.max("w"), "top"))


@query("SELECT x.id::BIGINT AS a, y.id::BIGINT AS b, round(sum(x.w * y.w), 5) AS similarity FROM wts x JOIN wts y ON x.term = y.term JOIN news a ON a.row_pos = x.id JOIN news b ON b.row_pos = y.id AND a.topic = b.topic AND (a.published_at < b.published_at OR (a.published_at = b.published_at AND a.row_pos < b.row_pos)) AND date_diff('hour', a.published_at, b.published_at) <= 14 * 24 GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.3", "news", _TFIDF)
def j07_tfidf_band_join(spark, sf):
    found = X.similar_texts(news(spark, sf), 0.3, 14, min_df=2, max_share=0.9)
    return found.select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("SELECT row_pos::BIGINT AS row_pos, previous::BIGINT AS previous, round(sim, 6) AS similarity, n::BIGINT AS n FROM (SELECT y.row_pos, x.row_pos AS previous, list_dot_product(x.unit, y.unit) AS sim, row_number() OVER (PARTITION BY y.row_pos ORDER BY list_dot_product(x.unit, y.unit) DESC, x.row_pos) AS n FROM u x JOIN u y ON x.topic = y.topic AND x.published_at < y.published_at AND y.published_at - x.published_at <= INTERVAL 30 DAY JOIN comp cx ON cx.row_pos = x.row_pos JOIN comp cy ON cy.row_pos = y.row_pos WHERE cx.component <> cy.component AND list_dot_product(x.unit, y.unit) >= 0.2) WHERE n <= 10", "u comp")
def j09_fallback_previous(spark, sf):
    c = clusters(spark, sf).select("row_pos", F.col("component").alias("cluster_id"))
    return P.fallback_previous(news(spark, sf), c, 30, 0.2, 10).select("row_pos", "previous", r6("similarity"), F.col("n").cast("long").alias("n"))


_KNN = "q AS (SELECT row_pos AS query_id, unit AS qv FROM u WHERE row_pos % 100 = 0), knn AS (SELECT query_id, row_pos, score, n FROM (SELECT query_id, row_pos, list_dot_product(qv, unit) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv, unit), 9) DESC, news_id) AS n FROM q, u) WHERE n <= 10)"


def knn(spark, sf, k=10):
    n = news(spark, sf)
    return S.nearest_of_many(n.where("row_pos % 100 = 0").select(F.col("row_pos").alias("query_id"), F.col("embedding").alias("query")), n, k)


@query("SELECT query_id::BIGINT AS query_id, row_pos::BIGINT AS row_pos, round(score, 6) AS score, n::BIGINT AS rank FROM knn", "u", _KNN)
def j10_vector_neighbours(spark, sf):
    return knn(spark, sf).select("query_id", F.col("news_id").cast("long").alias("row_pos"), r6("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT row_pos::BIGINT AS row_pos, component::BIGINT AS component FROM comp", "comp")
def g01_connected_components(spark, sf):
    return clusters(spark, sf).select("row_pos", "component")


@query("SELECT c.row_pos::BIGINT AS row_pos, 'exp00b_' || lpad((k - 1)::VARCHAR, 5, '0') AS cluster_id FROM comp c JOIN (SELECT component, row_number() OVER (ORDER BY first) AS k FROM (SELECT component, min((published_at, row_pos)) AS first FROM comp JOIN news USING (row_pos) GROUP BY 1)) USING (component)", "comp news")
def g02_numbered_clusters(spark, sf):
    return A.numbered(clusters(spark, sf), news(spark, sf)).select("row_pos", "cluster_id")


@query("SELECT row_pos::BIGINT AS row_pos, topic || '_' || (dense_rank() OVER (PARTITION BY topic ORDER BY component) - 1)::VARCHAR AS cluster_id FROM comp JOIN news USING (row_pos)", "comp news")
def g03_topic_component_ids(spark, sf):
    x = clusters(spark, sf).join(news(spark, sf).select("row_pos", "topic"), "row_pos")
    ids = x.select("topic", "component").distinct().withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy("component")) - 1)
    return x.join(ids, ["topic", "component"]).select("row_pos", F.concat_ws("_", "topic", F.col("k").cast("string")).alias("cluster_id"))


_RESCUE = "e2 AS (SELECT a, b FROM edges UNION SELECT a, b FROM pairs WHERE sim >= 0.2 AND days <= 7 AND (tj >= 0.05 OR shared >= 1)), r2(id, low) AS (SELECT row_pos, row_pos FROM news UNION SELECT e.y, r.low FROM r2 r JOIN (SELECT a AS x, b AS y FROM e2 UNION ALL SELECT b, a FROM e2) e ON e.x = r.id)"


@query("SELECT id::BIGINT AS row_pos, min(low)::BIGINT AS component FROM r2 GROUP BY 1", "edges pairs news", _RESCUE)
def g04_two_pass_edges(spark, sf):
    n = news(spark, sf)
    rescue = P.candidate_pairs(n, 0.2, 7).where("title_jaccard >= 0.05 OR shared_numbers_count >= 1").select(F.col("left_row_pos").alias("a"), F.col("right_row_pos").alias("b"))
    return C.labelled(n.select("row_pos"), edges(spark, sf).select("a", "b").union(rescue), "row_pos").select("row_pos", "component")


@query("SELECT source::BIGINT AS source, target::BIGINT AS target, source_size::BIGINT AS source_size, target_size::BIGINT AS target_size, pair, round(best, 6) AS best_similarity, round(min_days, 6) AS min_days_diff, round(max_tj, 6) AS max_title_jaccard, max_shared::BIGINT AS max_shared_numbers, round(second, 6) AS second_best, round(best - second, 6) AS margin FROM sel", "sel")
def g06_best_candidate_attach(spark, sf):
    base = materialise(clusters(spark, sf))
    s = selected(near(spark, sf, base), base)
    return s.select("source", "target", "source_size", "target_size", F.concat_ws(" ", "source_news_id", "target_news_id").alias("pair"), r6("best_similarity"), r6("min_days_diff"), r6("max_title_jaccard"), F.col("max_shared_numbers_count").alias("max_shared_numbers"), r6("second_best_similarity", "second_best"), r6("margin"))


@query("SELECT row_pos::BIGINT AS row_pos, component::BIGINT AS baseline_component, cluster::BIGINT AS cluster, CASE WHEN target IS NULL THEN 'baseline' ELSE 'attach' END AS assignment_method, CASE WHEN split_part(pair, ' ', 1) = row_pos::VARCHAR THEN split_part(pair, ' ', 2) END AS parent, round(best, 6) AS similarity FROM fin", "fin")
def g07_provenance(spark, sf):
    return final(spark, sf).select("row_pos", "baseline_component", "cluster", "assignment_method", F.col("assignment_parent_news_id").alias("parent"), r6("assignment_similarity", "similarity"))


@query("SELECT component::BIGINT AS component, count(*) AS size FROM comp GROUP BY 1", "comp")
def a09_cluster_sizes(spark, sf):
    return clusters(spark, sf).groupBy("component").agg(F.count("*").alias("size"))


@query("SELECT source::BIGINT AS source, target::BIGINT AS target, round(best, 6) AS best, round(min_days, 6) AS min_days, round(max_tj, 6) AS max_tj, max_shared::BIGINT AS max_shared FROM agg", "agg")
def a10_attach_candidates(spark, sf):
    base = materialise(clusters(spark, sf))
    c, n = CALIBRATED, news(spark, sf)
    sizes = base.groupBy("component").agg(F.count("*").alias("size"))
    own = base.select("row_pos", "component").join(sizes, "component")
    p = P.candidate_pairs(n, c["attach"], c["attach_days"]).where((F.col("title_jaccard") >= c["title_jaccard"]) | (F.col("shared_numbers_count") >= c["shared_numbers"]))
    p = p.join(own.toDF("ca", "left_row_pos", "sa"), "left_row_pos").join(own.toDF("cb", "right_row_pos", "sb"), "right_row_pos").where("ca <> cb")
    keep = ["similarity", "days_diff", "title_jaccard", "shared_numbers_count"]
    both = p.select(F.col("ca").alias("source"), F.col("cb").alias("target"), F.col("sa").alias("ss"), F.col("sb").alias("ts"), *keep).union(p.select("cb", "ca", "sb", "sa", *keep)).where("ss <= 2 AND ts > ss")
    return both.groupBy("source", "target").agg(r6(F.max("similarity"), "best"), r6(F.min("days_diff"), "min_days"), r6(F.max("title_jaccard"), "max_tj"), F.max("shared_numbers_count").alias("max_shared"))


@query("SELECT row_pos::BIGINT AS row_pos, pos::BIGINT AS position_in_cluster, round(since_prev, 6) AS days_since_previous, round(since_start, 6) AS days_since_cluster_start FROM feat", "feat")
def w01_w02_positions_and_gaps(spark, sf):
    return feature_rows(spark, sf).select("row_pos", "position_in_cluster", r6("days_since_previous"), r6("days_since_cluster_start"))


@query("SELECT row_pos::BIGINT AS row_pos, round(mx, 6) AS mx, round(mean, 6) AS mean, round(mn, 6) AS mn, round(top2, 6) AS top2, round(top3, 6) AS top3, round(last, 6) AS last FROM feat", "feat")
def w03_w05_previous_similarity(spark, sf):
    return feature_rows(spark, sf).select("row_pos", r6("max_prev_similarity", "mx"), r6("mean_prev_similarity", "mean"), r6("min_prev_similarity", "mn"), r6("top2_mean_similarity", "top2"), r6("top3_mean_similarity", "top3"), r6("last_prev_similarity", "last"))


@query("SELECT row_pos::BIGINT AS row_pos, round(cen, 6) AS similarity, round(1 - cen, 6) AS distance FROM feat", "feat")
def w06_running_centroid(spark, sf):
    return feature_rows(spark, sf).select("row_pos", r6("previous_centroid_similarity", "similarity"), r6("previous_centroid_distance", "distance"))


@query("SELECT row_pos::BIGINT AS row_pos, round(tj, 6) AS title_jaccard_max, round(xj, 6) AS text_jaccard_max, shared::BIGINT AS shared_numbers_count, fresh::BIGINT AS new_numbers_count, title_length::BIGINT AS title_length, text_length::BIGINT AS text_length FROM feat", "feat")
def w09_w10_lexical_evidence(spark, sf):
    return feature_rows(spark, sf).select("row_pos", r6("title_jaccard_max"), r6("text_jaccard_max"), "shared_numbers_count", "new_numbers_count", "title_length", "text_length")


_NAMED = "named AS (SELECT row_pos, pos AS position_in_cluster, pos AS cluster_size_so_far, since_prev AS days_since_previous, since_start AS days_since_cluster_start, mx AS max_prev_similarity, mean AS mean_prev_similarity, mn AS min_prev_similarity, last AS last_prev_similarity, cen AS previous_centroid_similarity, tj AS title_jaccard_max, xj AS text_jaccard_max, shared AS shared_numbers_count, fresh AS new_numbers_count FROM feat)"


@query("SELECT row_pos::BIGINT AS row_pos, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for n, x in W.DERIVED.items()) + " FROM named", "feat", _NAMED)
def p25_derived_features(spark, sf):
    d = W.derived(feature_rows(spark, sf))
    return d.select("row_pos", *[r6(c) for c in W.DERIVED])


@query("SELECT y.row_pos::BIGINT AS row_pos, count(x.row_pos) FILTER (y.published_at - x.published_at <= INTERVAL 3 DAY) AS n3, count(x.row_pos) AS n7 FROM news y LEFT JOIN news x ON x.topic = y.topic AND (x.published_at < y.published_at OR (x.published_at = y.published_at AND x.row_pos < y.row_pos)) AND y.published_at - x.published_at <= INTERVAL 7 DAY GROUP BY 1", "news")
def w14_window_density(spark, sf):
    n = news(spark, sf)
    return W.density(n, 3).withColumnRenamed("n", "n3").join(W.density(n, 7).withColumnRenamed("n", "n7"), "row_pos")


@query("SELECT y.row_pos::BIGINT AS row_pos, count(x.row_pos) AS topic_prev_count, round(coalesce(max(list_dot_product(x.unit, y.unit)), 0.0), 6) AS topic_prev_max, round(coalesce(list_avg(list_sort(list(list_dot_product(x.unit, y.unit)) FILTER (x.row_pos IS NOT NULL), 'DESC')[1:3]), 0.0), 6) AS topic_prev_top3 FROM u y LEFT JOIN u x ON x.topic = y.topic AND (x.published_at < y.published_at OR (x.published_at = y.published_at AND x.row_pos < y.row_pos)) AND y.published_at - x.published_at <= INTERVAL 30 DAY GROUP BY 1", "u")
def w15_topic_context(spark, sf):
    return W.topic_context(news(spark, sf), 30).select("row_pos", "topic_prev_count", r6("topic_prev_max"), r6("topic_prev_top3"))


@query("SELECT row_pos::BIGINT AS row_pos, CASE WHEN pos = 0 THEN 'significant' WHEN mx >= 0.33 THEN 'duplicate' WHEN mx >= 0.27 THEN 'minor' ELSE 'significant' END AS novelty_label, round(CASE WHEN pos = 0 THEN 1.0 ELSE 1 - mx END, 6) AS novelty, pos > 0 AND (abs(mx - 0.33) <= 0.02 OR abs(mx - 0.27) <= 0.02) AS needs_review, best_previous::BIGINT AS matched FROM feat", "feat")
def x04_rule_labels(spark, sf):
    return N.rule_labels(feature_rows(spark, sf), 0.27, 0.33).select("row_pos", "novelty_label", r6("novelty"), "needs_review", "matched")


_P = "1 / (1 + exp(-(0.5 - 3.0 * mx + 0.8 * tj + 0.1 * fresh)))"


@query(f"SELECT row_pos::BIGINT AS row_pos, round(CASE WHEN pos = 0 THEN 1.0 ELSE {_P} END, 6) AS p_significant, CASE WHEN pos = 0 OR {_P} >= 0.42 THEN 'significant' WHEN mx >= 0.33 THEN 'duplicate' ELSE 'minor' END AS novelty_label, pos > 0 AND abs({_P} - 0.42) <= 0.1 AS needs_review FROM feat", "feat")
def x03_scored_labels(spark, sf):
    f = feature_rows(spark, sf)
    p = N.logistic(f, {"max_prev_similarity": -3.0, "title_jaccard_max": 0.8, "new_numbers_count": 0.1}, 0.5)
    return N.labelled(f, p, duplicate=0.33).select("row_pos", r6("p_significant"), "novelty_label", "needs_review")


@query("SELECT cluster::BIGINT AS cluster, row_pos::BIGINT AS row_pos FROM feat WHERE pos = 0", "feat")
def w11_cluster_seeds(spark, sf):
    return feature_rows(spark, sf).where("position_in_cluster = 0").select("cluster", "row_pos")


_SUM = "cen AS (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(range(1, len(unit) + 1)) AS i, unnest(unit) AS x FROM u JOIN fin USING (row_pos)) GROUP BY 1, 2), mean AS (SELECT cluster, list(x ORDER BY i) AS m FROM cen GROUP BY 1), med AS (SELECT u.*, fin.cluster, rule.label, round(list_dot_product(unit, m) / greatest(sqrt(list_dot_product(m, m)), 1e-12), 12) AS central FROM u JOIN fin USING (row_pos) JOIN mean ON mean.cluster = fin.cluster JOIN rule ON rule.row_pos = u.row_pos)"


def labelled_news(spark, sf):
    labels = N.rule_labels(feature_rows(spark, sf), 0.27, 0.33).select("row_pos", "cluster", "novelty_label")
    return news(spark, sf).join(labels, "row_pos")


@query("SELECT cluster::BIGINT AS cluster, arg_min(news_id, (-central, CASE label WHEN 'significant' THEN -3 WHEN 'minor' THEN -2 ELSE -1 END, published_at, news_id)) AS representative, count(*) AS article_count, " + TS.format(x="min(published_at)") + " AS started_at, " + TS.format(x="max(published_at)") + " AS last_seen_at FROM med GROUP BY 1", "u fin rule", _SUM)
def a08_cluster_summaries(spark, sf):
    s = Y.summaries(labelled_news(spark, sf), ["cluster"])
    return s.select("cluster", F.col("representative_article_id").alias("representative"), "article_count", stamp("started_at"), stamp("last_seen_at"))


_ART = "art AS (SELECT n.*, c.component AS cluster_id, CASE WHEN n.row_pos % 7 = 0 THEN 'draft' ELSE 'public' END AS visibility, CASE WHEN n.row_pos % 11 = 0 THEN 'pending' ELSE 'processed' END AS status FROM u n JOIN comp c USING (row_pos)), scored AS (SELECT *, list_dot_product(unit, (SELECT unit FROM u WHERE row_pos = 0)) AS score FROM art WHERE status = 'processed' AND visibility = 'public' AND language = 'en'), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, news_id) AS rank FROM scored QUALIFY rank <= 100), hit AS (SELECT * FROM rk WHERE score >= 0.1), best AS (SELECT cluster_id, min(rank) AS o, max(score) AS s FROM hit GROUP BY 1 ORDER BY o LIMIT 10)"


def articles(spark, sf):
    base = materialise(clusters(spark, sf))
    n = news(spark, sf).join(base.select("row_pos", F.col("component").cast("string").alias("cluster_id")), "row_pos")
    return n.withColumn("visibility", F.when(F.col("row_pos") % 7 == 0, "draft").otherwise("public")).withColumn("status", F.when(F.col("row_pos") % 11 == 0, "pending").otherwise("processed")).withColumn("novelty_label", F.lit("significant"))


def no_summaries(spark):
    return spark.createDataFrame([], "organization_id string, cluster_id string, representative_article_id string, representative_title string, article_count long, started_at timestamp, last_seen_at timestamp")


def searched(spark, sf):
    """A search over stories that are stored first, as a server's would be."""
    rich = S.stored(articles(spark, sf), no_summaries(spark), folder(spark))
    return S.search_stored(rich, stated(news(spark, sf), 0), 10, S.visible(language="en"), 0.1)


@query("SELECT m.row_pos::BIGINT AS row_pos, b.cluster_id::VARCHAR AS cluster_id, row_number() OVER (ORDER BY b.o, m.published_at, m.news_id) AS rank, round(h.score, 6) AS score FROM best b JOIN art m ON m.cluster_id = b.cluster_id AND m.status = 'processed' AND m.visibility = 'public' LEFT JOIN hit h ON h.row_pos = m.row_pos", "u comp", _ART)
def j12_j13_search_items(spark, sf):
    _, items = searched(spark, sf)
    return items.select("row_pos", "cluster_id", F.col("rank").cast("long").alias("rank"), r6("score"))


@query("SELECT cluster_id::VARCHAR AS cluster_id, arg_min(news_id, rank) AS representative, count(*) AS article_count, " + TS.format(x="min(published_at)") + " AS published_from, " + TS.format(x="max(published_at)") + " AS published_to, round(any_value(s), 6) AS score, array_to_string(list(news_id ORDER BY published_at, rank), ' ') AS items FROM (SELECT m.*, b.s, row_number() OVER (ORDER BY b.o, m.published_at, m.news_id) AS rank FROM best b JOIN art m ON m.cluster_id = b.cluster_id AND m.status = 'processed' AND m.visibility = 'public') GROUP BY cluster_id", "u comp", _ART)
def a07_search_clusters(spark, sf):
    found, _ = searched(spark, sf)
    return found.select("cluster_id", F.col("representative_article_id").alias("representative"), "article_count", stamp("published_from"), stamp("published_to"), r6("score"), F.concat_ws(" ", "items").alias("items"))


@query("SELECT query_id::BIGINT AS query_id, row_pos::BIGINT AS row_pos, m::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS m FROM (SELECT knn.*, component FROM knn JOIN comp USING (row_pos) QUALIFY row_number() OVER (PARTITION BY query_id, component ORDER BY n) = 1)) WHERE m <= 5", "u comp", _KNN)
def w20_collapsed_ranking(spark, sf):
    base = materialise(clusters(spark, sf)).select("news_id", F.col("component").alias("cluster_id"))
    r = S.collapsed(knn(spark, sf).join(base, "news_id"), 5)
    return r.select("query_id", F.col("news_id").cast("long").alias("row_pos"), F.col("new_rank").cast("long").alias("rank"))


@query("SELECT count(*) AS queries, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, round(avg((hits > 0)::INT), 6) AS hit_rate, round(avg(hits), 6) AS relevant, round(avg(1 - stories / n), 6) AS repeat_rate, round(avg(stories), 6) AS unique_clusters FROM (SELECT query_id, min(CASE WHEN rel = 1 THEN n END) AS first, sum(rel) AS hits, count(*)::DOUBLE AS n, count(DISTINCT component) AS stories FROM (SELECT knn.query_id, knn.n, c.component, CASE WHEN x.topic = y.topic AND x.row_pos <> y.row_pos THEN 1 ELSE 0 END AS rel FROM knn JOIN comp c USING (row_pos) JOIN u x ON x.row_pos = knn.row_pos JOIN u y ON y.row_pos = knn.query_id) GROUP BY 1)", "u comp", _KNN)
def a19_retrieval_metrics(spark, sf):
    from newsloom.operators import metrics as M

    base = materialise(clusters(spark, sf)).select("news_id", F.col("component").alias("cluster_id"))
    t = news(spark, sf).select("news_id", "topic", "row_pos")
    r = knn(spark, sf).join(base, "news_id").join(t, "news_id").join(t.select(F.col("row_pos").alias("query_id"), F.col("topic").alias("qt")), "query_id")
    r = r.withColumn("relevant", F.when((F.col("topic") == F.col("qt")) & (F.col("row_pos") != F.col("query_id")), 1).otherwise(0)).withColumn("method", F.lit("vector"))
    return M.retrieval(r, ["method"]).select("queries", r6("mrr"), r6("hit_rate"), r6("relevant"), r6("repeat_rate"), r6("unique_clusters"))


@query("SELECT row_pos::BIGINT AS row_pos, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm, round(list_dot_product(unit, unit), 6) AS one, round(1 - list_dot_product(unit, (SELECT unit FROM u WHERE row_pos = 0)), 6) AS distance FROM u", "u")
def v01_v04_vector_functions(spark, sf):
    n = news(spark, sf)
    first = n.where("row_pos = 0").select(F.col("embedding").alias("q"))
    u = V.unit(F.col("embedding"))
    return n.crossJoin(F.broadcast(first)).select("row_pos", r6(V.norm(F.col("embedding")), "norm"), r6(V.dot(u, u), "one"), r6(V.distance(F.col("embedding"), F.col("q")), "distance"))


@query("SELECT topic, round(list_dot_product(m, m), 6) AS strength FROM (SELECT topic, list(x ORDER BY i) AS m FROM (SELECT topic, i, avg(x) AS x FROM (SELECT topic, unnest(range(1, 65)) AS i, unnest(unit) AS x FROM u) GROUP BY 1, 2) GROUP BY 1)", "u")
def v05_centroids(spark, sf):
    units = news(spark, sf).withColumn("unit", V.unit(F.col("embedding")))
    each = units.select("topic", F.posexplode("unit").alias("i", "x")).groupBy("topic", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("topic").agg(r6(F.sum(F.col("x") * F.col("x")), "strength"))


@query("SELECT a::BIGINT AS a, b::BIGINT AS b, concat_ws(' + ', CASE WHEN sim < 0.25 THEN 'low similarity' END, CASE WHEN days > 7 THEN 'far apart' END, CASE WHEN tj < 0.03 AND shared = 0 THEN 'no evidence' END) AS reason FROM pairs", "pairs")
def p27_edge_blockers(spark, sf):
    p = P.candidate_pairs(news(spark, sf), CALIBRATED["attach"], CALIBRATED["days"])
    why = F.array_compact(F.array(F.when(F.col("similarity") < 0.25, "low similarity"), F.when(F.col("days_diff") > 7, "far apart"), F.when((F.col("title_jaccard") < 0.03) & (F.col("shared_numbers_count") == 0), "no evidence")))
    return p.select(F.col("left_row_pos").alias("a"), F.col("right_row_pos").alias("b"), F.concat_ws(" + ", why).alias("reason"))


@query("SELECT a::BIGINT AS a, b::BIGINT AS b, round(sim, 6) AS similarity FROM (SELECT a, b, sim, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, a, b) AS n FROM (SELECT band.* FROM band JOIN comp x ON x.row_pos = a JOIN comp y ON y.row_pos = b WHERE x.component <> y.component AND sim >= 0.18)) WHERE n <= 20", "band comp")
def j28_hard_negatives(spark, sf):
    base = materialise(clusters(spark, sf)).select("row_pos", "component")
    n = news(spark, sf)
    side = lambda c, *more: base.select(F.col("row_pos").alias(c), F.col("component").alias(f"{c}_component"), *more)
    p = tiles.similar(n, 0.18, 14).join(side("a"), "a").join(side("b"), "b").where("a_component <> b_component").join(n.select(F.col("row_pos").alias("a"), "topic"), "a")
    best = F.row_number().over(Window.partitionBy("topic").orderBy(F.round("similarity", 12).desc(), "a", "b"))
    return p.withColumn("n", best).where("n <= 20").select("a", "b", r6("similarity"))


@query("SELECT row_pos::BIGINT AS row_pos, array_to_string(list(p_row::VARCHAR ORDER BY p_pos), ' ') AS context FROM (SELECT prev.*, row_number() OVER (PARTITION BY row_pos ORDER BY sim DESC, p_pos) AS n, row_number() OVER (PARTITION BY row_pos ORDER BY p_pos DESC) AS m FROM prev) WHERE n <= 3 OR m = 1 GROUP BY 1", "prev")
def w21_previous_context(spark, sf):
    rows = news(spark, sf).join(materialise(final(spark, sf)).select("row_pos", "cluster"), "row_pos")
    x = tiles.best_earlier(rows, 36500, 3, ["cluster"])
    own = F.array_distinct(F.concat(F.transform("tops", lambda t: F.struct((-t["d"]).alias("d"), t["key"].alias("key"))), F.array(F.struct((-F.col("last.d")).alias("d"), F.col("last.key").alias("key")))))
    return x.select("row_pos", F.concat_ws(" ", F.transform(F.array_sort(own), lambda t: t["key"].cast("string"))).alias("context"))
