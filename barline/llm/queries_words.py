"""The query of spelling variants and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import errata
from barline.llm.queries_native import crc32_sql

#: One run of so many loses a character.
ODD = 199


def noise(doc_id: Column, run: Column) -> Column:
    """``run``, or without one character where ODD divides the checksum of id and run.  A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % ODD == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, one in ODD runs with a character missing, with their near words, forms and roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return errata.variants(errata.count_words(docs, noise))


#: Pairs by the places of one wildcard, and by the deletions of one character.
OP13_SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{errata.LETTERS}')), '{errata.UPPER}', '{errata.LOWER}') AS w FROM documents) GROUP BY ALL),
crcs AS MATERIALIZED ({crc32_sql("runs", "k", "k")}),
odd AS (SELECT w, n, crc, CAST(crc % length(w) AS INT) AS pos FROM runs JOIN crcs USING (k)),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN crc % {ODD} = 0 THEN w[1:pos] || w[pos + 2:] ELSE w END AS word, n FROM odd)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, word[1:i] || chr(1) || word[i + 2:] AS hole, word[1:i] || word[i + 2:] AS short FROM words, unnest(range(0, length(word))) u(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS x, b.n AS m FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.short = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.short = w.word),
best AS (SELECT word, count(*) AS n_near, min((-m, x)) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * n THEN -b[1] END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.root WHERE e.form IS NULL
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": OP13_SQL}
