"""The registered queries of the operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontaminate, html_text, ngram_lm, packing, quality, secrets, simhash, topk, toxicity, urls
from tabloom.llm._common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secrets.train(secrets.labelled_samples(spark))
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents"), ratios))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(items, items.where("vec_id % 50 = 0"), k=5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"), order=3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_packing": op8_packing,
    "op9_lm": op9_lm,
    "op10_toxicity": op10_toxicity,
}

#: op2: every pair of a query and another vector, ranked.
_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: op6: windows by their words, joined by a character that separates words; hit words are counted once per place.
_CONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT n, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hits AS (SELECT n, i, dw.k, item FROM dw JOIN bw USING (k, g)), places AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS p FROM hits) GROUP BY n
), found AS (SELECT n, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (n) LEFT JOIN found USING (n)
"""

ORACLES: dict[str, str] = {"op2_topk": _TOPK, "op6_decontamination": _CONTAMINATION}
