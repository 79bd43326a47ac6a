"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which the rows of one join key are dealt.
SALTS = 32


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if driver and workers are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="barline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``facts``, which have one row for each ``key``.

    A key's rows are dealt by ``by`` over SALTS tasks, and its fact goes only to
    those of them that have rows, so a key that holds most rows fills no task.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    wanted = dealt.select(key, "_salt").distinct().join(facts, key)
    return dealt.join(wanted, [key, "_salt"]).drop("_salt")


def attach_few(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``attach`` for facts that are few beside the rows: each goes to SALTS tasks, which saves shuffles."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(facts.select("*", salts), [key, "_salt"]).drop("_salt")


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``table`` that no later plan reads."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
