"""A corpus pipeline over `documents`: toxic documents go, one document of each
near-duplicate group stays, sources are mixed to target weights, and what is
left is encoded.  Each stage works on all that the stage before has kept.
Mixing orders the rows (``slot``) and cuts none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import jaccard, mixing, shared, tokens, toxicity
from barline.llm.queries_map import tokenizer_file

#: Score from which a document is toxic.
TOXIC = 0.7
#: Sources get shares in proportion to their rows to this power, out of so many parts.
ALPHA, PARTS = 0.7, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from labels with remainder 0 or 2.

    Null and empty texts score 0 and stay, as do all rows if there are no
    labels of both kinds; repeats score alike; other columns pass unseen.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score_column("text", model) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked at Jaccard 0.75.

    Null and empty texts link with nothing and stay; of repeats of id and text
    one stays; a null id is never the smallest unless all are null.  Columns of
    any names pass unchanged.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``slot`` in the mix, each once.  When a source
    has run out its slots stay empty, and the others go on in proportion to
    their weights; ``in_mix`` is true before the first such slot.

    A null source is a source of its own; rows without an id or text are mixed
    like others; ties go by the other columns' hash.  Columns called ``slot`` or
    ``in_mix`` are replaced, all others pass unchanged.
    """
    others = [c for c in docs.columns if c not in ("slot", "in_mix")]
    mixed = mixing.mix(docs.select(*(F.col(f"`{c}`").alias(f"own_{c}") for c in others)), alpha=ALPHA, parts=PARTS, doc_id="own_doc_id", source="own_source")
    return mixed.select(*(F.col(f"`own_{c}`").alias(c) for c in others), "slot", "in_mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each whole text's ids and their decoding, with the slots.

    A null text counts as empty; repeats give equal rows; other columns are left out.
    """
    return tokens.encoding_digests(docs, tokenizer_file("word_bpe_49k.json"), carry=("slot", "in_mix"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: A learned score decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = shared.table(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
