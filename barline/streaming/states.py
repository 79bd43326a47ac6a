"""Controller state and reward scales over unbounded input, in typed state with timers.

Both need the RocksDB state store (``STATE_STORE``); state is a few numbers a
key, and for a reward batch that is still open its values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Setting that the queries need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def controller_steps(pos: Sequence[float], state: tuple | None, bench: float, cap: int, cooldown: int, eps: float) -> tuple[list[tuple], tuple]:
    """(over, delta, hold_age, under_age, cooldown) before each bar, and the state after the last.

    The state is the last position and overlay, bars since a trade, bars since
    the last crossing of the benchmark, whether below it, bars in all and since the last rise.
    """
    last, before, held, side, low, n, rise = state or (bench, 0.0, -1, 0, None, 0, -1)
    out = []
    for now in pos:
        over = last - bench
        delta, below, n = over - before, over < -eps, n + 1
        held = 0 if abs(delta) > eps else held + 1
        side = side + 1 if low in (None, below) else 1
        rise = 0 if below and delta > eps else rise + 1 if rise >= 0 else rise
        left = max(min(1.0, cooldown / cap) - rise / cap, 0.0) if rise >= 0 else 0.0
        out.append((over, delta, min(held / cap, 1.0), min(side / cap, 1.0) if below else 0.0, left))
        last, before, low = float(now), over, below
    return out, (last, before, held, side, low, n, rise)


class _Controller(StatefulProcessor):
    def __init__(self, names: tuple[str, str, str], settings: tuple):
        self.names, self.settings = names, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("controller", "last double, before double, held int, side int, low boolean, n long, rise long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sym, ts, pos = self.names
        table = pd.concat(list(rows)).sort_values(ts, kind="stable")
        steps, after = controller_steps(table[pos].tolist(), tuple(self.state.get()) if self.state.exists() else None, *self.settings)
        self.state.update(after)
        yield pd.DataFrame([(key[0], t, *s) for t, s in zip(table[ts], steps)], columns=[sym, ts, "over", "delta", "hold_age", "under_age", "cooldown"])

    def close(self) -> None:
        pass


def live_controller(positions: DataFrame, bench: float = 1.0, cap: int = 64, cooldown: int = 0, eps: float = 1e-6) -> DataFrame:
    """(sym, ts, over, delta, hold_age, under_age, cooldown) of a stream (sym, ts, pos): ``diagnostics.controller_state``, carried on.

    A symbol's rows are taken by time within a batch; batches come in order.
    """
    rows = positions.select("sym", F.col("ts").cast("timestamp").alias("ts"), F.col("pos").cast("double").alias("pos"))
    schema = "sym string, ts timestamp, over double, delta double, hold_age double, under_age double, cooldown double"
    return rows.groupBy("sym").transformWithStateInPandas(_Controller(("sym", "ts", "pos"), (bench, cap, cooldown, eps)), schema, "Append", "None")


class _Scale(StatefulProcessor):
    def __init__(self, decay: float, idle: int):
        self.decay, self.idle = decay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scale = handle.getValueState("scale", "low double, high double")
        self.batch = handle.getValueState("batch", "batch long")
        self.values = handle.getListState("values", "value double")

    def _closed(self, key) -> pd.DataFrame:
        """The figures of the open batch, which ends here."""
        values = [v[0] for v in self.values.get()]
        low, high = np.percentile(values, [5, 95])
        if self.scale.exists():
            was = self.scale.get()
            low, high = (self.decay * a + (1 - self.decay) * b for a, b in zip(was, (low, high)))
        self.scale.update((float(low), float(high)))
        number = int(self.batch.get()[0])
        self.batch.clear()
        self.values.clear()
        return pd.DataFrame({"key": [key[0]], "batch": [number], "low": [low], "high": [high], "scale": [max(1.0, high - low)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows)).sort_values("batch", kind="stable")
        for number, part in table.groupby("batch", sort=True):
            if self.batch.exists() and int(self.batch.get()[0]) != number:
                yield self._closed(key)
            if not self.batch.exists():
                self.batch.update((int(number),))
            self.values.appendList([(float(v),) for v in part["value"].dropna()])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(table["ts"].max().timestamp() * 1000) + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.batch.exists():
            yield self._closed(key)

    def close(self) -> None:
        pass


def live_reward_scale(rewards: DataFrame, decay: float = 0.99, late: str = "0 seconds", idle: int = 60_000) -> DataFrame:
    """(key, batch, low, high, scale) of a stream (key, ts, batch, value): ``rewards.reward_scale``, one row when a batch ends.

    A batch ends with the first row of another, or by a timer ``idle``
    milliseconds of event time after its last row.  Batches come in order.
    """
    rows = rewards.select(F.col("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("batch").cast("long").alias("batch"), F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Scale(decay, idle), f"key {dict(rows.dtypes)['key']}, batch long, low double, high double, scale double", "Append", "EventTime")
