"""Bundles of named arrays (NPZ files) as rows, and rows as bundles.

Files are read by Spark, one row each, so that any store that Spark reaches will
do; a task parses its files' members and array headers.  A file must fit a task.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values in a piece of an array that is handed on at once.
PIECE = 100_000


def members(content: bytes, name: str = "bundle") -> dict[str, np.ndarray]:
    """The arrays of a bundle; ValueError if it, a header or a checksum is damaged, or an array isn't of numbers."""
    out = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.namelist():
                with archive.open(member) as stream:
                    array = np.lib.format.read_array(stream, allow_pickle=False)
                    if stream.read(1):
                        raise ValueError(f"{member} is longer than its header says")
                if array.dtype.kind not in "biuf":
                    raise ValueError(f"{member} holds {array.dtype}, not numbers")
                out[member.removesuffix(".npy")] = array
    except (zipfile.BadZipFile, ValueError, EOFError, OSError) as e:
        raise ValueError(f"{name}: {e}") from e
    return out


def unpacked(files: DataFrame, content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, name, shape, i, value): a row for each value of each array, ``i`` counting in row order from 0; null contents have none."""
    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "name string, shape array<long>, i long, value double"])

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                *kept, blob = row
                for name, array in members(blob, str(kept[0]) if kept else "bundle").items():
                    flat = array.reshape(-1).astype(np.float64)
                    for at in range(0, len(flat), PIECE):
                        piece = flat[at : at + PIECE]
                        yield pd.DataFrame({**{c: [v] * len(piece) for c, v in zip(keep, kept)}, "name": name, "shape": [list(array.shape)] * len(piece), "i": np.arange(at, at + len(piece)), "value": piece})

    return files.where(F.col(content).isNotNull()).select(*keep, content).mapInPandas(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, i, value) of NPZ files."""
    return unpacked(spark.read.format("binaryFile").load(path).select("path", "content"), keep=("path",))


def teachers(spark: SparkSession, folder: str) -> DataFrame:
    """(fold, role, i, position, source_id) of the files ``foldNN_teacher.npz``; -1 where a file names no source."""
    rows = read(spark, f"{folder}/fold*_teacher.npz").withColumn("fold", F.regexp_extract("path", r"fold(\d+)_teacher\.npz", 1).cast("int"))
    source = rows.where("name = 'source_id' and i = 0").select("fold", F.col("value").cast("int").alias("source_id"))
    role = F.regexp_extract("name", "^(train|val)_positions$", 1).alias("role")
    out = rows.select("fold", role, "i", F.col("value").alias("position")).where("role <> ''")
    return out.join(source, "fold", "left").withColumn("source_id", F.coalesce("source_id", F.lit(-1)))


def packed(rows: DataFrame, arrays: dict[str, str], by: Sequence[str], order: str = "ts") -> DataFrame:
    """(by, content): one bundle for each group, of the named columns in order, nulls as NaN.

    A name may carry a condition after a colon, ``{"train_positions": "pos:role = 'train'"}``, for the rows that it takes.
    """
    kinds = dict(rows.dtypes)
    taken = {name: column.partition(":") for name, column in arrays.items()}
    chosen = rows.select(*by, order, *(F.struct(F.expr(cond or "true").alias("on"), F.col(c).cast("double").alias("x")).alias(f"_{i}") for i, (c, _, cond) in enumerate(taken.values())))
    flat = chosen.select(*by, order, *(F.col(f"_{i}.{part}").alias(f"{part}_{i}") for i in range(len(taken)) for part in ("on", "x")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values(order, kind="stable"), io.BytesIO()
        np.savez(out, **{name: group.loc[group[f"on_{i}"].fillna(False).astype(bool), f"x_{i}"].to_numpy(dtype=np.float64) for i, name in enumerate(taken)})
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in by}, "content": [out.getvalue()]})

    return flat.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "content binary"]))

