"""Queries over the statistics of a whole corpus: language-model scores, importance weights, collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evtlake.llm import collocations, importance, pitman_yor
from evtlake.llm.common import table
from evtlake.llm.queries import WORDS_SQL
from evtlake.llm.registry import query


@query()
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_scores(table(spark, sf_dir, "documents"))


IMPORTANCE_SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
items AS (SELECT {WORDS_SQL} AS w FROM benchmark),
found AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM docs),
wanted AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM items),
hexed AS (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM found UNION SELECT g FROM wanted)),
hashed AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc_table),
source AS (SELECT bucket, count(*) AS s FROM found JOIN hashed USING (g) GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (g) GROUP BY 1),
gains AS (
  SELECT b.range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM source) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM target) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) b LEFT JOIN source ON source.bucket = b.range LEFT JOIN target ON target.bucket = b.range),
means AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM found JOIN hashed USING (g) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS p
  FROM docs d LEFT JOIN means m ON m.doc_id = d.doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + p DESC, doc_id) AS r, 25 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + p AS BIGINT) AS score,
       CASE WHEN r <= drawn THEN r END AS rank
FROM scored s LEFT JOIN ranked k ON k.doc_id = s.doc_id
"""


@query(IMPORTANCE_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, w[i : i + k - 1] AS g FROM lists, (SELECT unnest(range(1, 6)) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY 1, 2 HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY 1),
inner_parts AS (
  SELECT DISTINCT c.lang, c.g[i : i + k - 1] AS g, c.f
  FROM counts c, (SELECT unnest(range(2, 5)) AS k), LATERAL (SELECT unnest(range(1, len(c.g) - k + 2)) AS i) WHERE k < len(c.g)),
kept AS (
  SELECT c.* FROM counts c WHERE len(c.g) >= 2 AND NOT EXISTS (SELECT 1 FROM inner_parts b WHERE b.lang = c.lang AND b.g = c.g AND 100 * b.f >= 100 * c.f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c, LATERAL (SELECT unnest(range(1, len(c.g))) AS k) JOIN counts x ON x.lang = c.lang AND x.g = c.g[1 : k]
  JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, t.n, score FROM best b JOIN totals t ON t.lang = b.lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query(COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
