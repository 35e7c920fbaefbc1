"""The opN_ queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import counting, forest, licenses, mixing, naming, packing, quality, repair, scoring, subspaces, substrings, wand, wavelet
from .common import materialise, table
from .tokens import vocabulary


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspaces.linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.counted(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = materialise(packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json")))
    return packing.packed(parts).drop("copy")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return wand.ranked_documents(docs, items)


def op13_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = naming.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _op10_sql() -> str:
    stop = ", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))
    def within(r: quality.Rule) -> str:
        bounds = [(">=", r.least), ("<=", r.most)]
        return " AND ".join(f"{r.numerator}::DOUBLE {op} {r.denominator}::DOUBLE * {float(x)}::DOUBLE" for op, x in bounds if x is not None)

    rules = " AND ".join(f"({r.denominator}::DOUBLE < {r.since} OR ({within(r)}))" for r in quality.RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
two AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM two) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(l) AS n_word_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•‣]'))) AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[ \t\r]*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, ({quality.BASE}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {rules}) AS kept FROM b"""


QUERIES = {f.__name__: f for f in (op1_cube_mix, op2_license_scan, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_substring_dedup, op6_wavelet_shards, op7_token_counts, op8_attention_scores, op9_best_fit_packing, op10_quality_rules, op11_conversation_repair, op12_ranked_search, op13_block_naming)}
ORACLE_SQL = {"op2_license_scan": licenses.oracle(), "op3_ngram_jaccard_join": forest.ORACLE_SQL, "op5_substring_dedup": substrings.ORACLE_SQL, "op4_embedding_near_dedup": subspaces.ORACLE_SQL, "op10_quality_rules": _op10_sql(), "op12_ranked_search": wand.ORACLE_SQL, "op13_block_naming": naming.ORACLE_SQL}
