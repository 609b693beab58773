"""The contract queries over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, neighbours, quality, simhash, simple8b, substrings, token_counts, toxicity, urls
from .work import held_out, table

#: Host, path and verdict of the URL rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "mix_copy", "mix_key")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_table(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts, "op2_mixing": op2_mixing, "op3_token_ids": op3_token_ids,
        "op4_decontamination": op4_decontamination, "op5_toxicity": op5_toxicity, "op6_neighbours": op6_neighbours,
        "op7_simhash": op7_simhash, "op8_substrings": op8_substrings, "op9_urls": op9_urls, "op10_quality": op10_quality,
    }


OP2_SQL = """
WITH RECURSIVE sized AS (
  SELECT coalesce('s:' || source, 'null') AS k, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY 1
), rates AS (
  SELECT k, sqrt(size) / (SELECT sum(sqrt(size)) FROM sized) * (SELECT sum(size) FROM sized) / size AS rate FROM sized
), poisson AS (
  SELECT k, rate, 0 AS n, -rate AS l, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT k, rate, n + 1, l + ln(rate) - ln((n + 1)::DOUBLE), c + exp(l + ln(rate) - ln((n + 1)::DOUBLE)) FROM poisson
  WHERE n < ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT *, coalesce('s:' || source, 'null') AS k,
    (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM poisson p WHERE p.k = d.k AND p.c < d.u) AS times
  FROM drawn d
), copies AS (
  SELECT *, unnest(range(times)) AS i FROM counted
)
SELECT doc_id, text, lang, source, n_chars, i::INTEGER AS mix_copy,
  md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || i::VARCHAR) AS mix_key
FROM copies
"""

OP4_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, w[i:i + least(10, len(w)) - 1] AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM item_words)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes)
), found AS (
  SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.win = x.win AND p.n = x.n
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE r > 1
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP9_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parts AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), best AS (
  SELECT p.r, arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(u.verdict, length(u.host || u.path)) AS verdict
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.r
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (r)
"""


def oracle_sql() -> dict:
    return {"op2_mixing": OP2_SQL, "op4_decontamination": OP4_SQL, "op8_substrings": OP8_SQL, "op9_urls": OP9_SQL}
