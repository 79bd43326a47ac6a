"""Bars and execution over unbounded input, equal to the batch operators on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.operators import scans


def live_bars(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Bars by event type from a stream of events; a bar ends when the watermark passes it.

    State holds five partial figures for each open (type, window), whatever the
    number of events.  Rows later than ``late`` are dropped by the watermark.
    """
    price = 1 + F.col("value")
    key = F.struct("at", "event_id")
    rows = events.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("at"), "event_id", "value").withWatermark("at", late)
    found = rows.groupBy("sym", F.window("at", width).alias("_w")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("value").alias("volume"),
    )
    return found.select("sym", F.col("_w")["start"].cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def live_execution(targets: DataFrame, step: float = 0.04, bench: float = 1.0, low: float = 0.5, high: float = 1.12) -> DataFrame:
    """(sym, ts, pos): the position after each target, carried from batch to batch in state.

    A symbol's rows are taken by time within a batch; batches come in order.
    """

    def move(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("ts")
        (start,) = state.get if state.exists else (bench,)
        pos = scans.execute(rows["target"].to_numpy(), step=step, bench=start, low=low, high=high)
        state.update((float(pos[-1]),))
        yield pd.DataFrame({"sym": key[0], "ts": rows["ts"].to_numpy(), "pos": pos})

    rows = targets.select("sym", F.col("ts").cast("timestamp").alias("ts"), F.col("target").cast("double").alias("target"))
    return rows.groupBy("sym").applyInPandasWithState(move, "sym string, ts timestamp, pos double", "pos double", "append", GroupStateTimeout.NoTimeout)


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream's rows to parquet; ``once`` stops when the present input is used up."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
