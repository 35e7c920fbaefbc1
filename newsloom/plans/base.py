"""The registry of queries, the binding of the driver's tables to articles, and shared SQL for the oracle.

``news`` has one row for each vector: text, language and source of the document of equal
id, the vector's label as topic, and a time spread over 60 days. Vectors here are less
similar than an encoder's, so the registered queries take the thresholds of CALIBRATED;
the operators keep their own defaults.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import attach as A
from newsloom.operators import features as W
from newsloom.operators import pairs as P
from newsloom.operators.components import checkpoint_root, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FEW = 1_000_000  # ids that are broadcast, else shuffled
CALIBRATED = {"strong": 0.25, "attach": 0.15, "title_jaccard": 0.03, "shared_numbers": 1, "margin": 0.03, "days": 14, "attach_days": 7}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/newsloom-{uuid.uuid4().hex}"


def news(spark: SparkSession, sf: str) -> DataFrame:
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    if e.count() <= FEW:  # texts without a vector stay where they are
        d = d.join(F.broadcast(e.select("vec_id")), F.col("doc_id") == F.col("vec_id"), "left_semi")
    at = F.expr("timestampadd(HOUR, CAST((vec_id * 7) % 1440 AS INT), TIMESTAMP '2024-01-01 00:00:00')")
    return e.join(d, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").cast("string").alias("news_id"), F.col("vec_id").alias("row_pos"), at.alias("published_at"), F.col("label").cast("string").alias("topic"), F.substring("text", 1, 80).alias("title"), "text",
        F.col("source").alias("organization_id"), F.col("lang").alias("language"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def stated(rows: DataFrame, row_pos: int) -> list[float]:
    """The vector of a stated query; of an empty table, or one without that row, a single 0."""
    found = [r.embedding for r in rows.where(F.col("row_pos") == row_pos).select("embedding").collect()]
    return found[0] if found else [0.0]


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.edges(news(spark, sf), CALIBRATED["strong"], CALIBRATED["days"])


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(row_pos, news_id, component) of strong edges."""
    return A.baseline(news(spark, sf), CALIBRATED["strong"], CALIBRATED["days"])


def near(spark: SparkSession, sf: str, base: DataFrame) -> DataFrame:
    """Pairs with evidence of the rows that may be attached, with all rows; base is (row_pos, component, ...)."""
    c = CALIBRATED
    pairs = P.candidate_pairs(news(spark, sf), c["attach"], c["attach_days"], A.sources(base))
    return materialise(pairs.drop("text_jaccard"))


def selected(pairs: DataFrame, base: DataFrame) -> DataFrame:
    c = CALIBRATED
    return A.selection(pairs, base, c["attach"], c["attach_days"], 2, c["title_jaccard"], c["shared_numbers"], c["margin"])


def final(spark: SparkSession, sf: str) -> DataFrame:
    """(row_pos, news_id, cluster, ...) after the second pass."""
    base = materialise(clusters(spark, sf))
    return A.attached(base, selected(near(spark, sf, base), base))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return W.previous_only(news(spark, sf), materialise(final(spark, sf)))


TOK = "list_distinct(regexp_extract_all(lower({x}), '[A-Za-zА-Яа-яЁё0-9]+'))"
NUM = "list_distinct(regexp_extract_all(replace({x}, ',', '.'), '[0-9]+(?:[.,][0-9]+)?'))"
JAC = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_c = CALIBRATED
_DAYS = "date_diff('microsecond', {a}, {b}) / 86400e6"
CTE = {
    "news": "news AS (SELECT CAST(e.vec_id AS VARCHAR) AS news_id, e.vec_id AS row_pos, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((e.vec_id * 7) % 1440 AS INTEGER)) AS published_at, CAST(e.label AS VARCHAR) AS topic, substring(d.text, 1, 80) AS title, d.text AS text, d.source AS organization_id, d.lang AS language, e.embedding::DOUBLE[] AS embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)",
    "u": f"u AS (SELECT *, list_transform(embedding, lambda x: x / greatest(sqrt(list_dot_product(embedding, embedding)), 1e-12)) AS unit, {TOK.format(x='title')} AS tt, {TOK.format(x='text')} AS xt, list_distinct(list_concat({NUM.format(x='title')}, {NUM.format(x='text')})) AS nums FROM news)",
    "band": "band AS (SELECT a.row_pos AS a, b.row_pos AS b, a.topic, list_dot_product(a.unit, b.unit) AS sim, date_diff('microsecond', a.published_at, b.published_at) / 86400e6 AS days FROM u a JOIN u b ON a.topic = b.topic AND (a.published_at < b.published_at OR (a.published_at = b.published_at AND a.row_pos < b.row_pos)) AND b.published_at - a.published_at <= INTERVAL 14 DAY)",
    "edges": f"edges AS (SELECT a, b, sim, days FROM band WHERE sim >= {_c['strong']})",
    "reach": "reach(id, low) AS (SELECT row_pos, row_pos FROM news UNION SELECT e.y, r.low FROM reach r JOIN (SELECT a AS x, b AS y FROM edges UNION ALL SELECT b, a FROM edges) e ON e.x = r.id)",
    "comp": "comp AS (SELECT id AS row_pos, min(low) AS component FROM reach GROUP BY 1)",
    "pairs": f"pairs AS (SELECT band.*, {JAC.format(a='x.tt', b='y.tt')} AS tj, {JAC.format(a='x.xt', b='y.xt')} AS xj, len(list_intersect(x.nums, y.nums)) AS shared FROM band JOIN u x ON x.row_pos = a JOIN u y ON y.row_pos = b WHERE sim >= {_c['attach']})",
    "sizes": "sizes AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)",
    "ways": "ways AS (SELECT ca.component AS ca, cb.component AS cb, a, b, sim, days, tj, shared FROM pairs JOIN comp ca ON ca.row_pos = a JOIN comp cb ON cb.row_pos = b WHERE ca.component <> cb.component)",
    "cand": f"cand AS (SELECT w.*, s.size AS source_size, t.size AS target_size FROM (SELECT ca AS source, cb AS target, a AS sr, b AS tr, sim, days, tj, shared FROM ways UNION ALL SELECT cb, ca, b, a, sim, days, tj, shared FROM ways) w JOIN sizes s ON s.component = source JOIN sizes t ON t.component = target WHERE days <= {_c['attach_days']} AND s.size <= 2 AND t.size > s.size AND (tj >= {_c['title_jaccard']} OR shared >= {_c['shared_numbers']}))",
    "agg": "agg AS (SELECT source, target, any_value(source_size) AS source_size, any_value(target_size) AS target_size, max(sim) AS best, min(days) AS min_days, max(tj) AS max_tj, max(shared) AS max_shared, arg_min(sr::VARCHAR || ' ' || tr::VARCHAR, (-sim, sr::VARCHAR, tr::VARCHAR)) AS pair FROM cand GROUP BY 1, 2)",
    "sel": f"sel AS (SELECT * FROM (SELECT *, lead(best) OVER w AS second, row_number() OVER w AS n FROM agg WINDOW w AS (PARTITION BY source ORDER BY best DESC, target_size DESC, min_days, target)) WHERE n = 1 AND (second IS NULL OR best - second >= {_c['margin']}))",
    "fin": "fin AS (SELECT c.row_pos, c.component, coalesce(s.target, c.component) AS cluster, s.target, s.pair, s.best FROM comp c LEFT JOIN sel s ON s.source = c.component)",
    "ord": "ord AS (SELECT u.*, f.cluster, row_number() OVER (PARTITION BY f.cluster ORDER BY published_at, u.row_pos) - 1 AS pos FROM u JOIN fin f USING (row_pos))",
    "prev": f"prev AS (SELECT x.row_pos, y.row_pos AS p_row, y.pos AS p_pos, list_dot_product(x.unit, y.unit) AS sim, {JAC.format(a='x.tt', b='y.tt')} AS tj, {JAC.format(a='x.xt', b='y.xt')} AS xj, y.nums AS p_nums FROM ord x JOIN ord y ON x.cluster = y.cluster AND y.pos < x.pos)",
    "pagg": "pagg AS (SELECT row_pos, max(sim) AS mx, avg(sim) AS mean, min(sim) AS mn, sum(sim) AS r, list_sort(list(sim), 'DESC') AS sims, arg_max(sim, p_pos) AS last, max(tj) AS tj, max(xj) AS xj, list_distinct(flatten(list(p_nums))) AS seen, arg_min(p_row, (-sim, p_pos)) AS best_previous FROM prev GROUP BY 1)",
    "feat": "feat AS (SELECT *, CASE WHEN s > 0 THEN r0 / sqrt(s) ELSE 0.0 END AS cen FROM (SELECT o.row_pos, o.cluster, o.pos, coalesce(date_diff('microsecond', lag(published_at) OVER w, published_at) / 86400e6, -1.0) AS since_prev, date_diff('microsecond', first_value(published_at) OVER w, published_at) / 86400e6 AS since_start, coalesce(mx, 0.0) AS mx, coalesce(mean, 0.0) AS mean, coalesce(mn, 0.0) AS mn, coalesce(list_avg(sims[1:2]), 0.0) AS top2, coalesce(list_avg(sims[1:3]), 0.0) AS top3, coalesce(last, 0.0) AS last, coalesce(r, 0.0) AS r0, sum(1 + 2 * coalesce(r, 0.0)) OVER (PARTITION BY cluster ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, coalesce(p.tj, 0.0) AS tj, coalesce(p.xj, 0.0) AS xj, len(list_intersect(nums, coalesce(seen, []))) AS shared, len(list_filter(nums, lambda x: NOT list_contains(coalesce(seen, []), x))) AS fresh, length(title) AS title_length, length(text) AS text_length, best_previous FROM ord o LEFT JOIN pagg p USING (row_pos) WINDOW w AS (PARTITION BY cluster ORDER BY published_at, o.row_pos)))",
    "rule": "rule AS (SELECT row_pos, cluster, CASE WHEN pos = 0 THEN 'significant' WHEN mx >= 0.33 THEN 'duplicate' WHEN mx >= 0.27 THEN 'minor' ELSE 'significant' END AS label FROM feat)",
}
_NEEDS = {"u": "news", "band": "u", "edges": "band", "reach": "edges", "comp": "reach", "pairs": "band", "sizes": "comp", "ways": "pairs comp", "cand": "ways sizes", "agg": "cand", "sel": "agg", "fin": "sel comp", "ord": "fin u", "prev": "ord", "pagg": "prev", "feat": "pagg ord", "rule": "feat"}


def with_ctes(select: str, needs: str, extra: str = "") -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    parts = [CTE[n] for n in order] + ([extra] if extra else [])
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select


def query(sql: str | None = None, needs: str = "", extra: str = ""):
    """Register a query under its function's name, with its DuckDB counterpart if it has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_ctes(sql, needs, extra)
        return f

    return register


def r6(x, name: str | None = None):
    """A double, rounded for comparison."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), 6).alias(name or x)


def stamp(x, name: str | None = None):
    c = F.col(x) if isinstance(x, str) else x
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or x)
