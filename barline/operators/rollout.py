"""Closed-loop rollout of a controller: each bar's position is where the last one left it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from barline.frames import SYM
from barline.operators import scans

#: Settings of the executor; rates of 0 or 1 limit nothing.
EXECUTOR = {
    "bench": 1.0, "low": -0.5, "high": 0.12, "step": 10.0, "slope": 16.0, "rate_scale": 1.0, "gap_boost": 0.0, "least_band": 0.02, "grid": 0.0, "snap": 0.0,
    "active": 0.0, "under": 0.0, "over": 0.0, "eps": 0.05,
}


def adjustment_rate(signal: float, gap: float, band: float, scale: float = 1.0, boost: float = 0.0, least_band: float = 0.02) -> float:
    """Share of the gap that is closed: the trade signal, and more of it the farther the gap lies outside its band."""
    rate = min(max(signal * scale, 0.0), 1.0)
    if boost <= 0:
        return rate
    return min(rate + boost * float(np.tanh(max(abs(gap) - band, 0.0) / max(band, least_band))), 1.0)


def closed_loop(signal: np.ndarray, target: np.ndarray, band: np.ndarray, **settings: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 1 where a cap forced the benchmark) of overlay targets, trade signals and bands.

    A step goes towards the target by the adjustment rate, smoothly gated by
    the band, inside the bounds; the position is put on a grid and near the
    benchmark on it.  Bars away from it, below it or above it may be at most
    ``ceil(rate * n)`` of the first n; one too many becomes the benchmark.
    """
    k = EXECUTOR | settings

    def step(state, row):
        (at, n, *counts), (sig, aim, width) = state[0], row
        gap = aim - at
        share = adjustment_rate(sig, gap, width, k["rate_scale"], k["gap_boost"], k["least_band"]) / (1.0 + np.exp(-k["slope"] * (abs(gap) - width)))
        position = k["bench"] + min(max(at + share * (gap if k["step"] >= 10 else min(max(gap, -k["step"]), k["step"])), k["low"]), k["high"])
        if k["grid"] > 0:
            position = float(np.rint(position / k["grid"])) * k["grid"]
        over = position - k["bench"]
        if k["snap"] > 0 and abs(over) <= k["snap"]:
            over, position = 0.0, k["bench"]
        kinds = (abs(over) > k["eps"], over < -k["eps"], over > k["eps"])
        forced = any(kind and 0 < k[rate] < 1 and done + 1 > np.ceil(k[rate] * (n + 1)) for kind, rate, done in zip(kinds, ("active", "under", "over"), counts))
        if forced:
            over, position, kinds = 0.0, k["bench"], (False, False, False)
        return (over, n + 1, *(c + int(kind) for c, kind in zip(counts, kinds))), position, float(forced)

    path = scans.fold(((0.0, 0, 0, 0, 0), 0.0, 0.0), step, signal, target, band)
    return np.array([p for _, p, _ in path]), np.array([f for _, _, f in path])


def rollout(df: DataFrame, signal: str = "signal", target: str = "target", band: str = "band", outputs=("position", "forced"), by=SYM, **settings: float) -> DataFrame:
    """``closed_loop`` over each group's bars.

    The counts of capped bars are never forgotten, so a group, one policy's run
    over one fold, is one task; folds and policies run side by side.
    """
    return scans.scan(df, lambda *x: closed_loop(*x, **settings), (signal, target, band), tuple(outputs), by)
