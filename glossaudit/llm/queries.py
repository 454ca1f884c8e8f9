"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaudit.llm import quality_classifier, toxicity
from glossaudit.llm.bpe import bpe_round_trip
from glossaudit.llm.filter_audit import filter_audit
from glossaudit.llm.fingerprints import edited_fingerprints
from glossaudit.llm.html_extraction import extract_main_text, markup_labelled, train_extractor
from glossaudit.llm.labelled import remainder
from glossaudit.llm.lexical_search import lexical_search
from glossaudit.llm.mixing import mix_sources
from glossaudit.llm.ngram_join import ngram_join
from glossaudit.llm.pii import detect_pii
from glossaudit.llm.quality_rules import quality_rules
from glossaudit.llm.substring_dedup import repeated_spans
from glossaudit.llm.url_filter import filter_urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _judged(scores: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return _judged(toxicity.score_toxicity(docs, model), 3, 1, toxicity.THRESHOLD)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train_quality(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return _judged(quality_classifier.score_quality(docs, model), 5, 0, quality_classifier.THRESHOLD)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def page_model(spark: SparkSession, sf_dir: str) -> tuple:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return train_extractor(markup_labelled(pages, F.xxhash64(F.lit(11), "page_id", "url")))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_model(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_mix_sources, op3_substring_dedup, op4_quality_rules, op5_byte_bpe, op6_pii, op7_url_filter, op8_toxicity,
        op9_quality_classifier, op10_fingerprints, op11_html_extraction, op12_lexical_search, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    """For DuckDB; the other queries have tests against brute force, exact round trips or held-out accuracy."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5
    THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (
  SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM sets)
SELECT doc_id, len(s) AS n_shingles, class_id, (SELECT min(other) FROM reach WHERE id = sets.doc_id) AS component_id
FROM sets JOIN classes USING (doc_id)""",
        "op12_lexical_search": rf"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, big_n),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * big_n) // big_l)::BIGINT AS m FROM lengths, whole),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""",
        "op13_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
judged AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS fails,
    coalesce((SELECT max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) FROM labels l WHERE l.doc_id = cut.doc_id), 0) AS good,
    coalesce((SELECT max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) FROM labels l WHERE l.doc_id = cut.doc_id), 0) AS toxic
  FROM cut),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT filter_order, step, filter_order[step] AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
gone AS (
  SELECT part, filter_order, fails, n, good, toxic,
    CASE WHEN fails = '' THEN 9 ELSE list_min([strpos(filter_order, x) FOR x IN string_split(fails, '')]) END AS gone_at
  FROM masks, orders),
found AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN gone_at > step THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone_at = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone_at < step AND contains(fails, f) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone_at = step THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM gone JOIN steps USING (filter_order) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM found""",
    }
