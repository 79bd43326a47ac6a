"""Queries of the operators that map over a table without a shuffle of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import arc, media, shared, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; rows with remainder 1 are held out of the fit."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder("doc_id", 3) != 1))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (F.coalesce(_remainder("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests."""
    return tokens.encoding_digests(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every whole text against a budget of 1024 tokens."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC archives, converted to WARC files, and read back from those."""
    archives = arc.pages_to_arc(_table(spark, sf_dir, "pages"))
    path = shared.place(spark, "warc")
    arc.write_warc(arc.mark_revisits(arc.convert(archives)), path)
    back = arc.read_warc(spark, path)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a PNG column, read back and hashed."""
    return media.png_features(media.texts_to_png(_table(spark, sf_dir, "documents")))


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files stand on this machine and its workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {"op1_toxicity": op1_toxicity, "op2_bpe": op2_bpe, "op3_token_counts": op3_token_counts, "op4_arc_to_warc": op4_arc_to_warc, "op5_media": op5_media}
#: The archives' contents, straight from the pages.
OP4_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest),
r AS (SELECT p.*, CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

ORACLES = {"op4_arc_to_warc": OP4_SQL}
