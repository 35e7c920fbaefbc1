"""Queries of curation operators, guards and remaining aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import curation as U
from newsloom.operators import ledger as L
from newsloom.operators import prepare as R
from newsloom.operators import search as S
from newsloom.operators import summary as Y
from newsloom.operators.components import materialise, ranked

from .base import clusters, feature_rows, final, news, query, r6, stamp, table

TS = "strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT doc_id::BIGINT AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS topic FROM documents WHERE doc_id % 3 = 0")
def p04_restored_pool(spark, sf):
    d = _docs(spark, sf)
    pool = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("news_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("topic"))
    return R.restored(pool, d.select(F.col("doc_id").alias("news_id"), F.col("source").alias("topic"))).select(F.col("news_id").alias("doc_id"), "topic")


@query("SELECT doc_id::BIGINT AS doc_id, length(text)::BIGINT AS text_length, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM documents JOIN labels USING (doc_id)")
def p06_annotated(spark, sf):
    a = table(spark, sf, "labels").select(F.col("doc_id").cast("long").alias("news_id"), *[F.lit(None).cast("string").alias(c) for c in ("title", "text", "topic")])
    c = _docs(spark, sf).select(F.col("doc_id").alias("news_id"), F.substring("text", 1, 80).alias("title"), "text", F.col("lang").alias("topic"))
    return U.annotated(a, c).select(F.col("news_id").alias("doc_id"), "text_length", F.col("text_num_words").alias("words"))


@query("SELECT doc_id::BIGINT AS doc_id, length(substring(text, 1, 80) || '. ' || text)::BIGINT AS model_length, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE lang END AS topic, '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || ' 00:00:00' AS published_at FROM documents")
def p08_raw_normalised(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.substring("text", 1, 80).alias("title"), "text", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("lang")).alias("topic"), F.lit(None).cast("string").alias("tags"), F.concat(F.lit("2024/01/"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0")).alias("date"))
    return U.raw_normalised(d).select("doc_id", F.length("model_text").cast("long").alias("model_length"), "topic", stamp("published_at"))


@query("SELECT substring(sha256('u' || doc_id), 1, 24) AS news_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS topic FROM documents")
def p10_source_rows(spark, sf):
    d = _docs(spark, sf).select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.substring("text", 1, 80).alias("title"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("topic"), F.col("source").alias("tags"))
    return U.source_rows(d).select("news_id", "topic")


@query("SELECT event_id::BIGINT AS event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE round(value, 6) END AS value FROM events")
def p12_finite(spark, sf):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).when(F.col("event_id") % 5 == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select(F.col("event_id").cast("long").alias("event_id"), r6(T.finite(v), "value"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'duplicate' WHEN doc_id % 3 = 1 THEN 'minor' WHEN (doc_id % 100) / 100.0 >= 0.42 THEN 'significant' ELSE 'minor' END AS label FROM documents) GROUP BY 1")
def p23_backfilled(spark, sf):
    k = F.col("doc_id") % 3
    x = U.backfilled(F.when(k == 1, "minor").otherwise(" "), F.when(k == 0, "duplicate").otherwise(""), (F.col("doc_id") % 100) / 100.0)
    return _docs(spark, sf).groupBy(x.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT cell, count(*) AS n FROM (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'TP' WHEN quality = 0 AND toxic = 0 THEN 'TN' WHEN quality = 0 THEN 'FP' ELSE 'FN' END AS cell FROM labels) GROUP BY 1")
def p26_confusion_cells(spark, sf):
    return table(spark, sf, "labels").groupBy(U.confusion_cell(F.col("quality"), F.col("toxic")).alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT doc_id::BIGINT AS doc_id, sha256(substring(text, 1, 900)) AS head FROM documents WHERE n_chars BETWEEN 300 AND 3000")
def p29_p30_between_and_truncate(spark, sf):
    return _docs(spark, sf).where(F.col("n_chars").between(300, 3000)).select("doc_id", F.sha2(F.substring("text", 1, 900), 256).alias("head"))


@query("SELECT o_orderkey::BIGINT AS id FROM orders WHERE floor(o_totalprice) % 7 <> 0")
def p32_amount_guard(spark, sf):
    x = F.when(F.floor("o_totalprice") % 7 == 0, F.lit(0.5)).otherwise(F.floor("o_totalprice").cast("double"))
    return table(spark, sf, "orders").where(L.valid_amount(x)).select(F.col("o_orderkey").cast("long").alias("id"))


@query("SELECT doc_id::BIGINT AS news_id, CASE WHEN doc_id % 10 = 0 THEN 'minor' WHEN doc_id % 10 = 1 THEN NULL ELSE 'duplicate' END AS label, CASE WHEN doc_id % 10 = 0 THEN 'me' WHEN doc_id % 10 = 1 THEN NULL ELSE 'other' END AS actor FROM documents")
def p34_manual_labels(spark, sf):
    d = _docs(spark, sf)
    state = d.select(F.col("doc_id").alias("news_id"), F.lit("duplicate").alias("manual_novelty_label"), F.lit("other").alias("manual_novelty_actor_id"))
    labels = d.where("doc_id % 10 < 2").select(F.col("doc_id").alias("news_id"), F.when(F.col("doc_id") % 10 == 0, "minor").alias("label"))
    return U.overridden(state, labels, "me", F.current_timestamp()).select("news_id", F.col("manual_novelty_label").alias("label"), F.col("manual_novelty_actor_id").alias("actor"))


@query("SELECT cluster::BIGINT AS cluster, array_to_string(list(row_pos::VARCHAR ORDER BY row_pos)[1:3], ' ') AS shown FROM rule WHERE label <> 'duplicate' GROUP BY 1", "rule")
def p35_visible_items(spark, sf):
    from newsloom.operators import novelty as N

    x = N.rule_labels(feature_rows(spark, sf), 0.27, 0.33)
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("row_pos"))
    top = x.where("novelty_label <> 'duplicate'").withColumn("n", first).where("n <= 3")
    ids = F.transform(F.array_sort(F.collect_list("row_pos")), lambda i: i.cast("string"))  # three at most
    return top.groupBy("cluster").agg(F.concat_ws(" ", ids).alias("shown"))


@query("SELECT c_custkey::BIGINT AS id FROM customer WHERE contains(lower(c_name), '00001') AND c_mktsegment = 'BUILDING'")
def p36_user_filter(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("login"), F.col("c_mktsegment").alias("role"))
    return U.matching_users(u, "00001", "BUILDING").select("id")


@query("SELECT event_id::BIGINT AS id FROM events WHERE json_extract_string(props, '$.k') = '3' AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 1")
def s15_latest_job(spark, sf):
    j = table(spark, sf, "events").select(F.col("event_id").cast("long").alias("id"), F.col("props").alias("request"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    return U.latest_job(j, {"k": "3"}, "click").select("id")


@query("SELECT o_orderkey::BIGINT AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def j16_j17_semi_joins(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(li, "o_orderkey", "left_semi").select(F.col("o_orderkey").cast("long").alias("id"))


@query("SELECT s.cluster::BIGINT AS cluster, s.rep::BIGINT AS representative, n.title FROM (SELECT cluster, min(row_pos) AS rep FROM fin GROUP BY 1) s JOIN news n ON n.row_pos = s.rep", "fin news")
def j19_summary_titles(spark, sf):
    s = final(spark, sf).groupBy("cluster").agg(F.min("row_pos").alias("representative"))
    return s.join(news(spark, sf).select(F.col("row_pos").alias("representative"), "title"), "representative").select("cluster", "representative", "title")


@query("SELECT doc_id::BIGINT AS doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def j22_one_to_one(spark, sf):
    lab = table(spark, sf, "labels").withColumn("doc_id", F.col("doc_id").cast("long"))
    x = U.one_to_one(lab.select("doc_id", "quality"), lab.select("doc_id", "toxic"), "doc_id")
    return x.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


@query("SELECT row_pos::BIGINT AS row_pos, component::BIGINT AS component FROM comp", "comp")
def j24_saved_clusters(spark, sf):
    return U.complete(news(spark, sf).select("row_pos"), clusters(spark, sf), "row_pos", "component").select("row_pos", "component")


@query("SELECT d.doc_id::BIGINT AS doc_id, l.quality::BIGINT AS quality, (row_number() OVER (ORDER BY d.doc_id))::BIGINT AS place FROM documents d LEFT JOIN labels l USING (doc_id)")
def j25_reference_order(spark, sf):
    ref = ranked(_docs(spark, sf).select("doc_id"), F.col("doc_id").asc_nulls_last()).select("doc_id", (F.col("rank") + 1).alias("place"))
    x = U.in_order_of(ref, table(spark, sf, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")), "doc_id", "place")
    return x.select("doc_id", "quality", "place")


@query("SELECT strftime(day, '%Y-%m-%d') AS first, n AS value FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) WHERE n < 334 ORDER BY day LIMIT 1")
def a39_first_crossing(spark, sf):
    d = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return U.first_crossing(d, "n", "day", 334).where("first IS NOT NULL").select(F.date_format("first", "yyyy-MM-dd").alias("first"), "value")


@query("SELECT o_orderkey::BIGINT AS id, round(count(*) / ((1 + o_orderkey % 60)::DOUBLE), 6) AS rows_per_second FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a43_throughput(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("rows"))
    at = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    jobs = n.select(F.col("id").cast("long").alias("id"), "rows", at.alias("created_at"), F.timestamp_seconds(F.unix_timestamp(at) + 1 + F.col("id") % 60).alias("updated_at"))
    return U.throughput(jobs).select("id", r6("rows_per_second"))


@query("SELECT event_type, round(coalesce(sum(value) FILTER (user_id < 20), 0.0), 4) AS total, round(max(value), 6) AS top FROM events GROUP BY 1")
def a44_dashboard_sums(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.coalesce(F.sum(F.when(F.col("user_id") < 20, F.col("value"))), F.lit(0.0)), 4).alias("total"), r6(F.max("value"), "top"))


@query("SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n, round(sum(w), 4) AS weight, round(avg(w), 6) AS mean FROM (SELECT quality, toxic, CASE WHEN quality = 1 THEN 1.0 ELSE 0.25 END AS w FROM labels) GROUP BY 1, 2")
def a51_effective_weights(spark, sf):
    x = table(spark, sf, "labels").withColumn("w", F.when(F.col("quality") == 1, 1.0).otherwise(0.25))
    return x.groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"), r6(F.avg("w"), "mean"))


@query("SELECT s.cluster::BIGINT AS cluster, CASE WHEN a.cluster IS NULL THEN 'old' ELSE 'new' END AS version FROM (SELECT DISTINCT cluster FROM fin) s LEFT JOIN (SELECT DISTINCT cluster FROM fin JOIN news USING (row_pos) WHERE published_at >= TIMESTAMP '2024-02-15') a USING (cluster)", "fin")
def k06_refreshed_summaries(spark, sf):
    f = materialise(final(spark, sf))
    old = f.select("cluster").distinct().withColumn("version", F.lit("old"))
    late = news(spark, sf).where("published_at >= '2024-02-15'").select("row_pos")
    hit = f.join(late, "row_pos", "left_semi").select("cluster").distinct()
    return Y.refreshed(old, hit.withColumn("version", F.lit("new")), hit, ["cluster"])


@query("SELECT row_pos::BIGINT AS row_pos, round(list_avg(sims[1:5]), 6) AS top5 FROM pagg", "pagg")
def w18_top5_similarity(spark, sf):
    from newsloom.operators import tiles

    rows = news(spark, sf).join(materialise(final(spark, sf)).select("row_pos", "cluster"), "row_pos")
    x = tiles.best_earlier(rows, 36500, 5, ["cluster"])
    return x.select("row_pos", r6(F.aggregate("tops.s", F.lit(0.0), lambda s, x: s + x) / F.size("tops"), "top5"))


@query("SELECT DISTINCT id::BIGINT AS id FROM (SELECT doc_id AS id FROM labels UNION SELECT item_id FROM benchmark UNION SELECT page_id FROM pages)")
def u06_union_of_id_sets(spark, sf):
    ids = lambda t, c: table(spark, sf, t).select(F.col(c).cast("long").alias("id"))
    return ids("labels", "doc_id").union(ids("benchmark", "item_id")).union(ids("pages", "page_id")).distinct()
