"""Chunked scans give what one pass over each group gives, wherever chunks are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import chunks, scans

WIDTHS = (13, 1000)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for sym, n in (("a", 60), ("b", 23), ("c", 1)):
        step = 0
        for _ in range(n):
            step += int(rng.integers(1, 4))
            rows.append((sym, step, float(rng.normal(0, 0.01)), float(rng.choice([0.3, 0.3, 0.8, 1.0, 1.0, 1.3])), float(rng.integers(0, 4))))
    return spark.createDataFrame(rows, "sym string, ts int, ret double, target double, future_run double").repartition(3).cache()


def groups(df, *names):
    out = {}
    for r in df.orderBy("sym", "ts").collect():
        out.setdefault(r.sym, []).append([r[n] for n in names])
    return {k: np.array(v, dtype=float).T for k, v in out.items()}


def same(df, table, names, kernel, inputs):
    got, given = groups(df, *names), groups(table, *inputs)
    assert df.count() == table.count()
    for sym, x in given.items():
        want = kernel(*x)
        for a, b in zip(got[sym], want if isinstance(want, tuple) else (want,)):
            np.testing.assert_allclose(a, b, rtol=0, atol=1e-12)


@pytest.mark.parametrize("width", WIDTHS)
def test_affine(table, width):
    same(chunks.ema(table, ("ret",), 0.3, ("e",), width=width), table, ("e",), lambda x: scans.ema(x, 0.3), ("ret",))
    same(chunks.macd(table, "target", 3, 6, 2, width=width), table, ("macd", "macd_signal"), lambda x: scans.macd(x, 3, 6, 2), ("target",))
    same(chunks.differential_sharpe(table, width=width), table, ("dsr",), scans.differential_sharpe, ("ret",))


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("gamma", [1.0, 0.9])
def test_hindsight(table, width, gamma):
    ahead = [f"v{i}" for i in range(4)]
    df = chunks.hindsight(table, ahead=ahead, bench=1.0, gamma=gamma, width=width)
    same(df, table, ("best", "value", *ahead), lambda r: scans.hindsight_ahead(r, bench=1.0, gamma=gamma), ("ret",))


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("bars", [0, 1, 3, 10])
def test_min_hold(table, width, bars):
    same(chunks.min_hold(table, bars, width=width), table, ("held",), lambda x: scans.min_hold(x, bars), ("target",))


@pytest.mark.parametrize("width", WIDTHS)
def test_state_machines(table, width):
    same(chunks.smooth_aim(table, 0.1, 0.02, 1.0, 0.3, 1.12, confirm=3, step_scale=0.5, floor=0.45, width=width), table, ("aim",), lambda t, f: scans.smooth_aim(t, f, 0.1, 0.02, 1.0, 0.3, 1.12, confirm=3, step_scale=0.5, floor=0.45), ("target", "future_run"))
    same(chunks.execute(table, 0.8, 3, width=width), table, ("position",), lambda t: scans.execute(t, 0.8, 3), ("target",))
    same(chunks.regime_hold(table, 4, 0.05, "target", "o", width=width), table, ("o",), lambda t: scans.regime_hold(t, 4, 0.05), ("target",))
    same(chunks.overlay_chain(table, edge="ret", scale=100.0, down_cut=0.5, up_add=0.02, width=width), table, ("position",), lambda t, r: scans.overlay_chain(t, gate=scans.edge_gate(r, 0.0, 100.0), down_cut=0.5, up_add=0.02), ("target", "ret"))


def test_state_that_is_never_forgotten(table):
    """A count of all rows: every chunk must wait for the one before it."""

    def run(state, x):
        n = (state or (0.0,))[0] + np.arange(1, len(x) + 1)
        return (n,), (n[-1],)

    same(chunks.stateful(table, run, ("ret",), ("n",), width=30), table, ("n",), lambda x: np.arange(1.0, len(x) + 1), ("ret",))


def test_no_rows_and_more_columns(table):
    assert chunks.ema(table.limit(0), ("ret",), 0.3, ("e",)).count() == 0
    assert chunks.hindsight(table.limit(0)).count() == 0 and chunks.min_hold(table.limit(0), 3).count() == 0
    assert chunks.execute(table.limit(0)).count() == 0
    more = chunks.ema(table.withColumns({"e": F.lit("old"), "note": F.lit("x")}), ("ret",), 0.3, ("e",), by=("sym", "note"), width=9)
    assert dict(more.dtypes)["e"] == "double" and more.where("note = 'x'").count() == table.count()
