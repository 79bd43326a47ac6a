"""Queries of the operators on pairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import itq, jaccard, pivots


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of Jaccard 0.75 on 5-word shingles."""
    return jaccard.join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.9."""
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives just below each anchor's nearest rows of its label, on vectors of whole 256ths; one in seven labels is off by one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor"))
    return pivots.hard_negatives(rows)


#: Every anchor against every row.
OP12_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.uid, a.vec_id AS anchor_id, a.label = b.label AS same, b.uid AS other, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.uid <> b.uid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id, other) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.uid, p.k ORDER BY s.score DESC, s.id, s.other) AS rank
  FROM p JOIN s USING (uid) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n
"""

QUERIES = {"op9_embedding_near_dedup": op9_embedding_near_dedup, "op8_ngram_jaccard_join": op8_ngram_jaccard_join, "op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": OP12_SQL}
