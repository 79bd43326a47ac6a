"""Recurrences over time chunks: many tasks for one symbol.

A group's rows are cut by time into chunks of ``width`` seconds.  What a chunk
does to the state that comes in is put down in a few numbers, these are
composed along the group's chunks (a row each), and a second pass over the rows
starts every chunk with the state that then comes to it:

* ``affine``: exponential means and what is linear in them; a chunk is a matrix
  and a vector.
* ``hindsight``: the best worths before a chunk are a max-plus product of those
  after it; the actions taken are a map of a few numbers onto themselves.
* ``min_hold``: a chunk's effect depends only on the first place where it may
  switch, so it is one figure for each bar of the holding time.
* ``stateful``: any state machine.  Chunks run from the states that their
  predecessors left when they ran last, until each has run from the state that
  does come in.  Limiters, bands and holds forget their start, so that two or
  three rounds do; one that never forgets takes a round for each chunk, with
  one chunk's work in it.

Times are timestamps, or numbers that ``width`` counts in; rows of one group
have distinct times.  No chunk may be longer than fits a task.  Kernels take
NumPy columns in time order.  An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline import scratch
from barline.frames import SYM
from barline.operators import scans

DAY = 86_400
#: Seconds of a chunk: about 250 daily bars, 35,000 of 15 minutes.
WIDTH = 365 * DAY
AT = "_chunk"


def cut(df: DataFrame, width: float = WIDTH, ts: str = "ts") -> DataFrame:
    """``df`` with the number of each row's chunk."""
    kind = dict(df.dtypes)[ts]
    time = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 if kind.startswith(("timestamp", "date")) else F.col(ts)
    return df.withColumn(AT, F.floor(time / width).cast("long"))


def _columns(group: pd.DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    return [group[c].to_numpy(dtype=np.float64) for c in names]


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def _noted(rows: DataFrame, note: Callable[..., dict], inputs: Sequence[str], schema: str, by, ts: str, told: DataFrame | None = None) -> DataFrame:
    """(by, chunk, ...): one row for each chunk, from its columns (and its row of ``told``)."""
    keys = [*by, AT]
    out = f"{_kinds(rows, keys)}, {schema}"
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(group: pd.DataFrame, more: pd.DataFrame | None = None) -> pd.DataFrame:  # applyInPandas counts arguments
        if not len(group) or (more is not None and not len(more)):
            return pd.DataFrame({c: [] for c in [*keys, *fields]})
        group = group.sort_values(ts, kind="stable")
        made = note(*_columns(group, inputs)) if more is None else note(more.iloc[0], *_columns(group, inputs))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, **{f: [made[f]] for f in fields}})

    slim = rows.select(*keys, ts, *(c for c in inputs if c not in (*keys, ts)))
    if told is None:
        return slim.groupBy(*keys).applyInPandas(lambda group: run(group), out)
    return slim.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(run, out)


def _carried(notes: DataFrame, carry: Callable[[pd.DataFrame], list[dict]], schema: str, by) -> DataFrame:
    """(by, chunk, ...): what ``carry`` makes of a group's notes in the order of time, one for each chunk."""
    keys = [*by, AT]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(AT).reset_index(drop=True)
        made = pd.DataFrame(carry(group))
        return pd.concat([group[keys], made], axis=1)

    return notes.groupBy(*by).applyInPandas(run, f"{_kinds(notes, keys)}, {schema}")


def _finished(rows: DataFrame, told: DataFrame, kernel: Callable[..., tuple], inputs: Sequence[str], outputs: Sequence[str], by, ts: str) -> DataFrame:
    """The rows with the kernel's outputs, each chunk by its row of ``told``."""
    keep = [c for c in rows.columns if c not in (*outputs, AT)]
    schema = ", ".join([_kinds(rows, keep), *(f"`{o}` double" for o in outputs)])

    def run(group: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ts, kind="stable").reset_index(drop=True)
        made = kernel(more.iloc[0], *_columns(group, inputs)) if len(group) else [[] for _ in outputs]
        return group.assign(**dict(zip(outputs, made)))[[*keep, *outputs]]

    keys = [*by, AT]
    return rows.select(*keep, AT).groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(run, schema)


def affine(df: DataFrame, run: Callable, size: int, inputs: Sequence[str], outputs: Sequence[str], by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """Recurrences whose state after a row is linear in the one before it.

    ``run(state, *columns)`` gives (outputs, state after the last row); the
    state is an array of ``size`` numbers, or None at the start of a group.
    """
    rows, basis = cut(df, width, ts), np.eye(size)

    def note(*columns):
        blank = [np.zeros_like(c) for c in columns]
        return {"first": run(None, *columns)[1].tolist(), "shift": run(np.zeros(size), *columns)[1].tolist(), "turn": np.array([run(e, *blank)[1] for e in basis]).T.ravel().tolist()}

    def carry(notes):
        state, out = None, []
        for n in notes.itertuples():
            out.append({"state": None if state is None else state.tolist()})
            state = np.array(n.first) if state is None else np.array(n.turn).reshape(size, size) @ state + np.array(n.shift)
        return out

    notes = _noted(rows, note, inputs, "first array<double>, shift array<double>, turn array<double>", by, ts)
    told = _carried(notes, carry, "state array<double>", by)
    return _finished(rows, told, lambda at, *columns: run(None if at.state is None else np.array(at.state), *columns)[0], inputs, outputs, by, ts)


def ema(df: DataFrame, names: Sequence[str], alpha: float, outputs: Sequence[str], by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """Exponential means of columns, seeded with each group's first values."""

    def run(state, *columns):
        means = [scans.ema(c, alpha) if state is None else scans.ema(np.r_[s, c], alpha)[1:] for s, c in zip(np.zeros(len(columns)) if state is None else state, columns)]
        return means, np.array([m[-1] for m in means])

    return affine(df, run, len(names), names, outputs, by, ts, width)


def macd(df: DataFrame, price: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, outputs=("macd", "macd_signal"), by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """``scans.macd``; both outputs come one bar late and are null on a group's first row."""

    def after(state, x, n):
        return scans.ema(x, scans.span(n)) if state is None else scans.ema(np.r_[state, x], scans.span(n))[1:]

    def run(state, x):
        f, s, g = state if state is not None else (None, None, None)
        quick, lazy = after(f, x, fast), after(s, x, slow)
        line = quick - lazy
        mean = after(g, line, signal)
        before = (np.nan, np.nan) if state is None else (f - s, g)
        return (np.r_[before[0], line[:-1]], np.r_[before[1], mean[:-1]]), np.array([quick[-1], lazy[-1], mean[-1]])

    out = affine(df, run, 3, (price,), outputs, by, ts, width)
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in outputs})


def differential_sharpe(df: DataFrame, ret: str = "ret", output: str = "dsr", eta: float = 0.01, scale: float = 1.0, by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """``scans.differential_sharpe`` of ``scale`` times the returns; the state is both running moments."""

    def run(state, r):
        value, after = scans.sharpe_steps(r * scale, eta, (0.0, 0.0) if state is None else tuple(state))
        return (value,), np.array(after)

    return affine(df, run, 2, (ret,), (output,), by, ts, width)


def hindsight(df: DataFrame, ret: str = "ret", outputs=("best", "value"), ahead: Sequence[str] = (), actions: Sequence[float] = (0.0, 0.5, 1.0, 1.25), unit: float = 5.5e-4, bench: float | None = None, gamma: float = 1.0, by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """``scans.hindsight``; ``ahead`` names columns for the best worth from the next bar on by action, if wanted."""
    rows, n = cut(df, width, ts), len(actions)
    settings = (actions, unit, bench, gamma)

    def product(r):
        start = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
        return {"worth": scans.worths(r, *settings, last=start)[0][0].T.ravel().tolist(), "bars": len(r)}

    def backwards(notes):
        last, out = np.zeros(n), []
        for x in notes.iloc[::-1].itertuples():
            out.append({"last": last.tolist()})
            # worth[j, k]: from action j before the chunk to k after it
            last = (np.array(x.worth).reshape(n, n) + gamma**x.bars * last).max(axis=1)
        return out[::-1]

    def taken(policy, start):
        return np.array(scans.fold(start, lambda state, row: int(row[0][state]), policy), dtype=np.int64)

    def mapped(at, r):
        policy = scans.worths(r, *settings, last=np.array(at["last"]))[1]
        return {"last": list(at["last"]), "goes": [int(taken(policy, k)[-1]) for k in range(n)]}

    def forwards(notes):
        state, out = int(np.abs(np.asarray(actions)).argmin()), []
        for x in notes.itertuples():
            out.append({"last": list(x.last), "start": state})
            state = int(x.goes[state])
        return out

    def finish(at, r):
        value, policy = scans.worths(r, *settings, last=np.array(at["last"]))
        path = taken(policy, int(at["start"]))
        before = np.r_[int(at["start"]), path[:-1]].astype(np.int64)
        return (np.asarray(actions, dtype=np.float64)[path], value[np.arange(len(r)), before], *(value[1:].T if ahead else ()))

    ends = _carried(_noted(rows, product, (ret,), "worth array<double>, bars long", by, ts), backwards, "last array<double>", by)
    maps = _noted(rows, mapped, (ret,), "last array<double>, goes array<int>", by, ts, ends)
    told = _carried(maps, forwards, "last array<double>, start int", by)
    return _finished(rows, told, finish, (ret,), (*outputs, *ahead), by, ts)


def min_hold(df: DataFrame, bars: int, target: str = "target", output: str = "held", by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """``scans.min_hold``: switches that come too early are undone."""
    rows = cut(df, width, ts)

    def note(x):
        n = len(x)
        differs = np.full(n, n)  # the next place with another value
        for t in range(n - 2, -1, -1):
            differs[t] = differs[t + 1] if x[t] == x[t + 1] else t + 1
        end = np.empty((n + 1, 2))  # (value, age) after the chunk, by the place of a switch
        end[n] = np.nan
        for t in range(n - 1, -1, -1):
            again = t + max(bars, 1)
            again = n if again >= n else again if x[again] != x[t] else differs[again]
            end[t] = (x[t], n - t) if again == n else end[again]
        first = np.arange(min(bars + 1, n))
        return {"bars": n, "begin": float(x[0]), "at": x[first].tolist(), "here": end[first].ravel().tolist(), "later": end[differs[first]].ravel().tolist()}

    def carry(notes):
        state, out = None, []
        for c in notes.itertuples():
            held, age = state if state is not None else (c.begin, 0.0)
            out.append({"held": held, "age": age})
            place, state = int(max(bars - age, 0)), (held, age + c.bars)
            if place < c.bars:
                table = c.here if c.at[place] != held else c.later
                value, since = table[2 * place : 2 * place + 2]
                state = state if np.isnan(since) else (value, since)
        return out

    told = _carried(_noted(rows, note, (target,), "bars long, begin double, at array<double>, here array<double>, later array<double>", by, ts), carry, "held double, age double", by)

    def finish(at, x):
        step = lambda s, row: (row[0], 1) if row[0] != s[0] and s[1] >= bars else (s[0], s[1] + 1)
        return (np.array([held for held, _ in scans.fold((at["held"], at["age"]), step, x)]),)

    return _finished(rows, told, finish, (target,), (output,), by, ts)


def stateful(df: DataFrame, run: Callable, inputs: Sequence[str], outputs: Sequence[str], by=SYM, ts: str = "ts", width: float = WIDTH) -> DataFrame:
    """Any state machine: ``run(state, *columns)`` gives (outputs, state after the last row).

    The state is a tuple of numbers, or None at the start of a group.  States
    are compared exactly, so the result is that of one pass over each group.
    """
    rows = scratch.table(cut(df, width, ts), "rows")
    keys, schema = [*by, AT], "start array<double>, after array<double>"
    state_of = lambda x: None if x is None else tuple(map(float, x))
    note = lambda *columns: {"start": None, "after": list(map(float, run(None, *columns)[1]))}
    known = scratch.table(_noted(rows, note, inputs, schema, by, ts).withColumn("turn", F.lit(0)), "known")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        """The start that each chunk has by what is known, and whether it has run from there."""
        ran, latest = {}, {}
        for x in group.sort_values("turn", kind="stable").itertuples():
            ran[getattr(x, "at"), state_of(x.start)] = latest[getattr(x, "at")] = state_of(x.after)
        start, out = None, []
        for at in sorted(latest):
            ready = (at, start) in ran
            out.append((at, None if start is None else list(start), ready))
            start = ran[at, start] if ready else latest[at]
        made = pd.DataFrame(out, columns=[AT, "start", "ready"])
        return made.assign(**{k: group[k].iloc[0] for k in by})[[*keys, "start", "ready"]]

    for turn in itertools.count(1):
        # a walk over the group's chunks, a few numbers each
        plan = known.withColumnRenamed(AT, "at").groupBy(*by).applyInPandas(walk, f"{_kinds(known, keys)}, start array<double>, ready boolean")
        plan = scratch.table(plan, "plan")
        todo = plan.where("not ready").select(*(F.col(c).alias(c) for c in keys), "start")
        if not todo.limit(1).count():
            break
        some = rows.join(todo.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keys))), [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keys)], "left_semi")
        again = lambda at, *columns: {"start": at["start"], "after": list(map(float, run(state_of(at["start"]), *columns)[1]))}
        more = _noted(some, again, inputs, schema, by, ts, todo)
        known = scratch.table(known.union(more.withColumn("turn", F.lit(turn))), "known")
    return _finished(rows, plan, lambda at, *columns: run(state_of(at["start"]), *columns)[0], inputs, outputs, by, ts)


def smooth_aim(df: DataFrame, step: float, band: float, start: float, low: float, high: float, bench: float = 1.0, confirm: int = 0, least_scale: float = 0.0, step_scale: float = 1.0, floor: float | None = None, target: str = "target", future_run: str = "future_run", output: str = "aim", **where) -> DataFrame:
    """``scans.smooth_aim``; the state is the position and the length of the underweight run so far."""

    def run(state, x, ahead):
        now, past = state if state is not None else (float(np.clip(start, low, high)), 0.0)
        path = scans.smooth_aim(x, ahead, step, band, now, low, high, bench, confirm, least_scale, step_scale, floor, int(past))
        under = np.clip(x, low, high) < bench
        tail = len(x) - 1 - int(np.max(np.flatnonzero(~under), initial=-1))
        return (path,), (path[-1], tail + (past if tail == len(x) else 0.0))

    return stateful(df, run, (target, future_run), (output,), **where)


def execute(df: DataFrame, blend: float = 1.0, hold: int = 0, step: float = 0.04, bench: float = 1.0, low: float = 0.5, high: float = 1.12, target: str = "target", output: str = "position", **where) -> DataFrame:
    """``scans.execute``; the state is the position and the bars since the last trade."""
    run = lambda state, x: _last(scans.execute_states(x, blend, hold, step, bench, low, high, state))
    return stateful(df, run, (target,), (output,), **where)


def _last(states: list[tuple[float, float]]) -> tuple[tuple[np.ndarray], tuple[float, float]]:
    return (np.array([at for at, _ in states]),), states[-1]


def regime_hold(df: DataFrame, bars: int, dead: float, target: str, output: str, **where) -> DataFrame:
    """``scans.regime_hold``; the state is the overlay and the bars since its last move."""
    return stateful(df, lambda state, x: _last(scans.regime_hold_states(x, bars, dead, state)), (target,), (output,), **where)


def overlay_chain(df: DataFrame, target: str = "target", edge: str | None = None, centre: float = 0.0, scale: float = 1.0, risk: str | None = None, output: str = "position", by=SYM, ts: str = "ts", width: float = WIDTH, **settings: float) -> DataFrame:
    """``scans.overlay_chain``: the overlay is bounded row by row, smoothed by ``ema``, then held and stepped.

    ``edge`` names a column that an edge gate is made of, ``risk`` one with a risk gate's shares (``teachers.risk_gate``).
    """
    k = scans.OVERLAY | settings
    bounded, smooth, shaped = "_bounded", "_smooth", ("bench", "low", "high", "down_cut", "up_add", "down_scale", "up_scale")
    keep = [c for c in df.columns if c != output]

    def bound(batches):
        for rows in batches:
            gate = scans.edge_gate(rows[edge].to_numpy(dtype=np.float64), centre, scale) if edge else None
            yield rows.assign(**{bounded: scans.overlay_bounded(rows[target].to_numpy(dtype=np.float64), gate, risk=rows[risk].to_numpy(dtype=np.float64) if risk else None, **{n: k[n] for n in shaped})})

    def run(state, x):
        held, now = state if state is not None else (x[0], 0.0)
        held = scans.held_band(x, k["hold_band"], held)
        path = np.array(scans.fold(now, lambda at, row: scans.toward(at, row[0], k["step"]), np.where(np.abs(held) < k["dead"], 0.0, held)))
        return (k["bench"] + path,), (held[-1], path[-1])

    df = df.select(*keep).mapInPandas(bound, f"{_kinds(df, keep)}, {bounded} double")
    df = ema(df, (bounded,), k["alpha"], (smooth,), by, ts, width)
    return stateful(df, run, (smooth,), (output,), by, ts, width).drop(bounded, smooth)
