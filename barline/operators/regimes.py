"""Hidden states of returns: fitted on training rows, decoded by the most likely path on the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barline.operators import scans


def viterbi(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """The most likely states of a Gaussian hidden Markov model (on ties the first), by max-product steps with back-pointers."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    with np.errstate(divide="ignore"):
        begin, step = np.log(start), np.log(move)
    like = -0.5 * ((np.asarray(x)[:, None] - mean) / std) ** 2 - np.log(std)
    back, best = np.zeros(like.shape, dtype=np.int64), begin + like[0]
    for t in range(1, len(x)):
        reached = best[:, None] + step  # from, to
        back[t] = reached.argmax(axis=0)
        best = reached.max(axis=0) + like[t]
    path = np.empty(len(x), dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decoded(rows: DataFrame, states: int = 3, rounds: int = 100, ret: str = "ret", role: str = "role", apart: str = "test", by=("sym", "fold"), ts: str = "ts") -> DataFrame:
    """The rows of role ``apart`` with their ``state`` (0: the lowest mean) and the states' probabilities ``p0``, ``p1``, ...

    The model of a group, a symbol's fold, is fitted to its training rows only,
    by ``rounds`` of expectation and maximisation from evenly spaced quantiles
    (with none, these are the model).  Null returns are left out of the fit and
    have no state; groups with fewer than two training rows have none at all.
    A group's rows are one task's work.
    """
    made = [f"p{i}" for i in range(states)]
    keep = [c for c in rows.columns if c not in ("state", *made)]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "state int", *(f"{p} double" for p in made)])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ts, kind="stable")
        x = group.loc[group[role] == "train", ret].dropna().to_numpy(dtype=np.float64)
        out = group[group[role] == apart][keep].reset_index(drop=True)
        state, shares = pd.array([pd.NA] * len(out), dtype="Int32"), np.full((len(out), states), np.nan)
        seen = np.flatnonzero(out[ret].notna().to_numpy())
        if len(x) > 1 and len(seen):
            model, y = scans.fit_hmm(x, states, rounds), out[ret].to_numpy(dtype=np.float64)[seen]
            state[seen] = viterbi(y, *model)
            shares[seen] = scans.forward_backward(y, *model)
        return out.assign(state=state, **{p: shares[:, i] for i, p in enumerate(made)})

    return rows.select(*keep).groupBy(*by).applyInPandas(run, schema)
