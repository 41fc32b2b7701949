"""One query per operator of this package over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evtlake.llm import (
    bpe, chat_format, decontaminate, html_text, jaccard_join, quality_mil, quality_rules, secret_scan, sharding, token_rollup)
from evtlake.llm.common import table
from evtlake.llm.registry import query
from evtlake.plans.ordering import scratch_path

WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM docs, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 5 * c.c >= 4 * (x.n + y.n - c.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, min(r.b) AS class_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links FROM reach r GROUP BY r.a
"""


@query(JACCARD_SQL)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT m FROM item_windows), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
hits AS (SELECT d.doc_id, d.i, d.m, v.item_id FROM doc_windows d JOIN item_windows v ON v.m = d.m AND v.g = d.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + m)) AS p) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""


@query(DECONTAMINATION_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[0-9A-Za-z]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"}
ROLLUP_SQL = " UNION ALL ".join(f"""
SELECT source, lang, '{name}' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{pattern}'))) AS BIGINT) AS n_tokens
FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1) GROUP BY 1, 2""" for name, pattern in VERSIONS.items())


@query(ROLLUP_SQL)
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: a load, a revision of estimated counts, a deletion of toxic documents, and the revision once more."""
    docs = table(spark, sf_dir, "documents")
    words, pieces = ({name: VERSIONS[name]} for name in VERSIONS)
    estimate = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", F.lit("pieces-1").alias("tokenizer"), F.expr("n_chars div 4").alias("n_tokens"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.col("doc_id").cast("string").alias("doc_id"), *[F.lit(None).cast("string").alias(c) for c in token_rollup.KEYS], F.lit(None).cast("long").alias("n_tokens"))
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup"))
    rollup.apply("1-load", token_rollup.counted(docs, words).unionByName(estimate).withColumn("op", F.lit("insert")))
    revision = token_rollup.counted(docs, pieces).withColumn("op", F.lit("revise"))
    rollup.apply("2-revise", revision)
    rollup.apply("3-delete", gone.withColumn("op", F.lit("delete")))
    rollup.apply("2-revise", revision)
    return rollup.totals()


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    encoded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.minimax_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM twice, LATERAL (SELECT unnest(range(i, i + 3)) AS p) GROUP BY 1),
lines AS (SELECT r, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM docs),
measured AS (
  SELECT d.r, d.doc_id, d.source, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l.l) AS BIGINT) AS n_lines, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM docs d JOIN lines l ON l.r = d.r LEFT JOIN repeated p ON p.r = d.r),
failing AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * word_chars OR n_dup_lines > 0.3 * n_lines AS counted FROM measured),
hosts AS (SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (counted))::DOUBLE AS f FROM failing GROUP BY 1),
sums AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS share FROM hosts),
prior AS (SELECT mean, q - mean * mean - mean * (1 - mean) * share AS between_hosts FROM sums),
strength AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM prior),
rates AS (SELECT source, round((f + mean * s) / (n + s), 9) AS host_rate FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rate > 0.8 AS kept, round(host_rate, 6) AS host_rate
FROM failing JOIN rates ON rates.source IS NOT DISTINCT FROM failing.source
"""


@query(RULES_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def _is(kind: str):
    return lambda s: s["kind"] == kind


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    counts = [F.size(F.filter("secrets", _is(kind))).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


@query()
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))
