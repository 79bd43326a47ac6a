"""The language model's query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import kneser_ney


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every whole text; rows with remainder 2 aren't learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    flagged = docs.select("doc_id", "text", F.coalesce(remainder != 2, F.lit(True)).alias("train"))
    scored = kneser_ney.score(flagged, "train")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
