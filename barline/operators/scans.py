"""Order-dependent recurrences: state that depends on past decisions.

Each kernel takes the rows of one group in time order as arrays.  Groups are
(sym[, fold[, setting]]), so folds and settings run side by side; a group's
rows, a few numbers each, are all that a task holds.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barline.frames import SYM


def scan(df: DataFrame, kernel: Callable[..., np.ndarray | tuple], inputs: tuple[str, ...], outputs: tuple[str, ...], by=SYM, ts: str = "ts") -> DataFrame:
    """Add the kernel's outputs (doubles) to each group's rows, in time order."""
    keep = [c for c in df.columns if c not in outputs]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{o}` double" for o in outputs])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ts, kind="stable").reset_index(drop=True)
        made = kernel(*(group[c].to_numpy(dtype=np.float64) for c in inputs))
        made = made if isinstance(made, tuple) else (made,)
        return group.assign(**dict(zip(outputs, made)))[[*keep, *outputs]]

    return df.select(*keep).groupBy(*by).applyInPandas(run, schema)


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean, seeded with the first value."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Difference of two exponential means and its own, both one bar late."""
    line = ema(close, span(fast)) - ema(close, span(slow))
    late = lambda x: np.r_[np.nan, x[:-1]]
    return late(line), late(ema(line, span(signal)))


def worths(ret: np.ndarray, actions, unit: float, bench: float | None, gamma: float, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best worth before each bar by the position held, best action by it), backwards from ``last``, the worths after the final bar (0).

    ``last`` may stack several cases (cases x actions); results have that axis too.
    """
    a = np.asarray(actions, dtype=np.float64)
    change = unit * np.abs(a[None, :] - a[:, None])  # from, to
    n, last = len(ret), np.zeros(len(a)) if last is None else last
    value, policy = np.zeros((n + 1, *last.shape)), np.zeros((n, *last.shape), dtype=np.int64)
    value[n] = last
    for t in range(n - 1, -1, -1):
        choice = ((a - (bench or 0.0)) * ret[t] + gamma * value[t + 1])[..., None, :] - change
        policy[t] = choice.argmax(axis=-1)
        value[t] = np.take_along_axis(choice, policy[t][..., None], axis=-1)[..., 0]
    return value, policy


def hindsight(ret: np.ndarray, actions=(0.0, 0.5, 1.0, 1.25), unit: float = 5.5e-4, bench: float | None = None, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Best positions in hindsight under costs, from flat, and their values."""
    value, policy = worths(ret, actions, unit, bench, gamma)
    flat = int(np.abs(np.asarray(actions)).argmin())
    taken = np.array(fold(flat, lambda state, row: int(row[0][state]), policy), dtype=np.int64)
    before = np.r_[flat, taken[:-1]].astype(np.int64)[: len(ret)]
    return np.asarray(actions, dtype=np.float64)[taken], value[np.arange(len(ret)), before]


def hindsight_ahead(ret: np.ndarray, actions=(0.0, 0.5, 1.0, 1.25), unit: float = 5.5e-4, bench: float | None = None, gamma: float = 1.0) -> tuple:
    """``hindsight``, and for each action the best worth from the next bar on."""
    value, _ = worths(ret, actions, unit, bench, gamma)
    return (*hindsight(ret, actions, unit, bench, gamma), *value[1:].T)


def fold(state, step: Callable, *columns: np.ndarray) -> list:
    """The states after each row, by the transition ``step(state, row)``."""
    return list(accumulate(zip(*columns), step, initial=state))[1:]


def toward(now: float, aim: float, most: float) -> float:
    """From ``now`` to ``aim`` by ``most`` at most."""
    return now + float(np.clip(aim - now, -most, most))


def min_hold(target: np.ndarray, bars: int) -> np.ndarray:
    """Switches that come before ``bars`` bars at the last position are undone."""

    def step(state, row):
        held, age = state
        free = row[0] != held and age >= bars
        return (row[0], 1) if free else (held, age + 1)

    return np.array([held for held, _ in fold((target[0], 0), step, target)]) if len(target) else target


def confirmed(aim: np.ndarray, under: np.ndarray, ahead: np.ndarray, bars: int, bench: float, least: float, past: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(aims, shares): underweights count in full once their run, up to here or from here on, has ``bars`` bars, ``past`` of them before the first row."""
    n = np.arange(len(aim))
    share = np.maximum(np.maximum(n - np.maximum.accumulate(np.where(under, -1 - past, n)), ahead) / bars, least)
    share = np.where(under, np.minimum(share, 1.0), 1.0)
    return bench + (aim - bench) * share, share


def smooth_aim(target: np.ndarray, future_run: np.ndarray, step: float, band: float, start: float, low: float, high: float, bench: float = 1.0, confirm: int = 0, least_scale: float = 0.0, step_scale: float = 1.0, floor: float | None = None, past: int = 0) -> np.ndarray:
    """A path towards the targets: confirmed underweights (``past`` bars of a run before the first row), dead band, limited steps."""
    aim, most = np.clip(target, low, high), np.full(len(target), max(step, 1e-6))
    if bench != 0.0:
        under = aim < bench
        if confirm > 0:
            aim, share = confirmed(aim, under, future_run, confirm, bench, least_scale, past)
            most = np.where(under, most * np.maximum(share, step_scale), most)
        if floor is not None:
            aim = np.where(aim < bench, np.maximum(aim, np.clip(floor, low, high)), aim)
    move = lambda now, row: now if abs(row[0] - now) <= band else float(np.clip(toward(now, *row), low, high))
    return np.array(fold(float(np.clip(start, low, high)), move, aim, most))


def execute(target: np.ndarray, blend: float = 1.0, hold: int = 0, step: float = 0.04, bench: float = 1.0, low: float = 0.5, high: float = 1.12) -> np.ndarray:
    """Targets blended with the benchmark, locked after a trade, in limited steps."""
    return np.array([at for at, _ in execute_states(target, blend, hold, step, bench, low, high)])


def execute_states(target: np.ndarray, blend: float, hold: int, step: float, bench: float, low: float, high: float, start: tuple[float, float] | None = None) -> list[tuple[float, float]]:
    """(position, bars since the last trade) after each row."""
    aims = np.clip((1 - blend) * bench + blend * target, low, high)

    def trade(state, row):
        at, idle = state
        after = float(np.clip(toward(at, row[0], step), low, high)) if idle >= hold else at
        return after, idle + 1 if abs(after - at) <= 1e-8 else 0

    return fold(start or (bench, hold), trade, aims)


def execute_grid(target: np.ndarray, specs: list[tuple[float, float, int]], bench: float = 1.0, low: float = 0.5, high: float = 1.12) -> tuple[np.ndarray, ...]:
    """``execute`` for many settings (blend, step, hold) at once: all take each bar together."""
    blend, step, hold = (np.array(x, dtype=np.float64) for x in zip(*specs))
    aims = np.clip((1 - blend) * bench + blend * np.asarray(target)[:, None], low, high)

    def trade(state, row):
        at, idle = state
        after = np.where(idle >= hold, np.clip(at + np.clip(row[0] - at, -step, step), low, high), at)
        return after, np.where(np.abs(after - at) <= 1e-8, idle + 1, 0)

    path = [at for at, _ in fold((np.full(len(specs), bench), hold), trade, aims)]
    return tuple(np.array(path).reshape(len(target), len(specs)).T)


def held_band(x: np.ndarray, band: float, start: float | None = None) -> np.ndarray:
    """The last value that lay ``band`` or more from the one held before it, from the first value or ``start``."""
    return np.array(fold(x[0] if start is None else start, lambda now, row: row[0] if abs(row[0] - now) >= band else now, x)) if len(x) else x


def edge_gate(edge: np.ndarray, centre: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Share, 0 to 1, that rises with an edge about its centre."""
    return 1.0 / (1.0 + np.exp(-np.clip((np.nan_to_num(edge) - centre) * scale, -30.0, 30.0)))


#: Settings of the overlay chain.
OVERLAY = {"bench": 1.0, "low": -0.5, "high": 0.12, "alpha": 0.2, "hold_band": 0.02, "dead": 0.01, "step": 0.05, "down_scale": 1.0, "up_scale": 1.0, "down_cut": 0.0, "up_add": 0.0}


def overlay_bounded(target: np.ndarray, gate: np.ndarray | None = None, bench: float = 1.0, low: float = -0.5, high: float = 0.12, down_cut: float = 0.0, up_add: float = 0.0, down_scale: float = 1.0, up_scale: float = 1.0, risk: np.ndarray | None = None) -> np.ndarray:
    """Overlays, scaled on either side of the benchmark, those below it by a risk gate's share; then by an edge gate's those
    below cut and others raised; and bounded."""
    over = target - bench
    over = np.where(over < 0, over * down_scale, over * up_scale)
    if risk is not None:
        over = np.where(over < 0, over * risk, over)
    if gate is not None:
        over = np.where(over < 0, over * (1 - down_cut * gate), over)
        over = np.where(over >= 0, over + up_add * gate, over)
    return np.clip(over, low, high)


def overlay_chain(target: np.ndarray, bench: float = 1.0, low: float = -0.5, high: float = 0.12, alpha: float = 0.2, hold_band: float = 0.02, dead: float = 0.01, step: float = 0.05, gate: np.ndarray | None = None, down_cut: float = 0.0, up_add: float = 0.0, down_scale: float = 1.0, up_scale: float = 1.0, risk: np.ndarray | None = None) -> np.ndarray:
    """Overlay scaled, gated by risk and protected by an edge gate, bounded, smoothed, held inside a band, zeroed when small, stepped from 0."""
    over = overlay_bounded(target, gate, bench, low, high, down_cut, up_add, down_scale, up_scale, risk)
    over = held_band(ema(over, alpha) if len(over) else over, hold_band)
    over = np.where(np.abs(over) < dead, 0.0, over)
    return bench + np.array(fold(0.0, lambda now, row: toward(now, row[0], step), over))


def regime_hold(target: np.ndarray, bars: int, dead: float) -> np.ndarray:
    """Overlays, from flat, that move by more than ``dead`` only after ``bars`` bars without a move."""
    return np.array([at for at, _ in regime_hold_states(target, bars, dead)])


def regime_hold_states(target: np.ndarray, bars: int, dead: float, start: tuple[float, float] | None = None) -> list[tuple[float, float]]:
    """(overlay, bars since its last move) after each row."""

    def step(state, row):
        at, idle = state
        after = at if idle < bars and abs(row[0] - at) > dead else row[0]
        return after, idle + 1 if abs(after - at) <= 1e-8 else 0

    return fold(start or (0.0, bars), step, target)


def rate_cap(fire: np.ndarray, share: float) -> np.ndarray:
    """Fires beyond ``ceil(share * n)`` are dropped, in time order."""
    seen = np.cumsum(fire > 0)
    return np.where(seen <= np.ceil(share * len(fire)), fire, 0.0)


def soft_step(now: float, aim: float, rate: float, band: float, step: float, slope: float = 50.0) -> float:
    """One step of the smooth executor."""
    gap = aim - now
    return now + min(max(rate, 0.0), 1.0) / (1.0 + np.exp(-slope * (abs(gap) - band))) * min(max(gap, -step), step)


def soft_path(aim: np.ndarray, rate: np.ndarray, band: np.ndarray, step: float, start: float, low: float, high: float, slope: float = 50.0) -> np.ndarray:
    """The smooth executor over a path of aims, trade rates and bands."""
    return np.array(fold(start, lambda now, row: float(np.clip(soft_step(now, *row, step, slope), low, high)), aim, rate, band))


def differential_sharpe(ret: np.ndarray, eta: float = 0.01) -> np.ndarray:
    """Differential Sharpe ratio with running first and second moments."""
    return sharpe_steps(ret, eta, (0.0, 0.0))[0]


def sharpe_steps(ret: np.ndarray, eta: float, start: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """(differential Sharpe ratio, both moments after the last row), from the moments ``start``."""
    moments = [ema(np.r_[s, x], eta) for s, x in zip(start, (ret, ret * ret))]
    a, b = (m[:-1] for m in moments)
    return (b * (ret - a) - 0.5 * a * (ret * ret - b)) / (b - a * a + 1e-8) ** 1.5, (moments[0][-1], moments[1][-1])


def forward_backward(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """State probabilities of a Gaussian hidden Markov model with given parameters (rows x states)."""
    like = np.exp(-0.5 * ((x[:, None] - mean) / std) ** 2) / std + 1e-300
    n, k = like.shape
    ahead, back = np.empty((n, k)), np.ones((n, k))
    for t in range(n):
        p = (start if t == 0 else ahead[t - 1] @ move) * like[t]
        ahead[t] = p / p.sum()
    for t in range(n - 2, -1, -1):
        p = move @ (like[t + 1] * back[t + 1])
        back[t] = p / p.sum()
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True)


def fit_hmm(x: np.ndarray, states: int = 3, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, moves, means, deviations) of a Gaussian hidden Markov model by expectation and maximisation, states in order of their means.

    The first guess puts the means at evenly spaced quantiles, so the fit needs
    no random numbers and gives the same result each time.
    """
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    std = np.full(states, max(float(np.std(x)), 1e-6))
    start, move = np.full(states, 1.0 / states), np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    last = -np.inf
    for _ in range(rounds):
        like = np.exp(-0.5 * ((x[:, None] - mean) / std) ** 2) / std + 1e-300
        scale, ahead = np.empty(len(x)), np.empty_like(like)
        for t in range(len(x)):
            p = (start if t == 0 else ahead[t - 1] @ move) * like[t]
            scale[t] = p.sum()
            ahead[t] = p / scale[t]
        back, pairs = np.ones(states), np.zeros((states, states))
        both = np.empty_like(like)
        both[-1] = ahead[-1]
        for t in range(len(x) - 2, -1, -1):
            reach = like[t + 1] * back / scale[t + 1]
            pairs += ahead[t][:, None] * move * reach
            back = move @ reach
            both[t] = ahead[t] * back
        weight = both.sum(axis=0) + 1e-12
        start, move = both[0] / both[0].sum(), (pairs + 1e-12) / (pairs + 1e-12).sum(axis=1, keepdims=True)
        mean = both.T @ x / weight
        std = np.sqrt(np.maximum((both * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-12))
        now = float(np.log(scale).sum())
        if now - last < tol:
            break
        last = now
    order = np.argsort(mean, kind="stable")
    return start[order], move[np.ix_(order, order)], mean[order], std[order]


def regimes(ret: np.ndarray, states: int = 3) -> tuple[np.ndarray, ...]:
    """Probabilities of the states of a model that is fitted to the same returns, the lowest mean first."""
    if len(ret) < 2:
        return tuple(np.full(len(ret), 1.0 / states) for _ in range(states))
    return tuple(forward_backward(ret, *fit_hmm(ret, states)).T)
