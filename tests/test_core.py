"""Operators against literal fixtures, re-derivations and invariants."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import scalar
from barline.operators import align, backtest, diagnostics, features, folds, labels, overfit, rewards, scans, selection
from barline.sources import bars


def frame(spark, columns, rows):
    """Rows of one symbol, one day apart."""
    start = datetime(2020, 1, 1)
    data = [("a", start + timedelta(days=i), *map(float, r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "sym string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def test_final_excess(spark):
    df = frame(spark, ("ret", "pos"), [(0.1, 0.5), (-0.02, 0.5), (0.03, 0.5)])
    row = backtest.summary(df, unit=0.0).first()
    assert row.total_return == pytest.approx(0.056540614675494)
    assert row.bench_return == pytest.approx(0.116278070458871)
    assert row.final_excess == pytest.approx(-0.059737455783377)
    assert row.max_dd == pytest.approx(-0.009950166156183)
    assert row.maxdd_delta == pytest.approx(-0.009851160357891)
    paid = backtest.summary(df, unit=5.5e-4).first()
    assert paid.total_return == pytest.approx(0.056250105953239)
    assert paid.bench_return == pytest.approx(0.115664286326228)


def test_hindsight_golden():
    pos, value = scans.hindsight(np.array([0.01, -0.02, 0.005, 0.03, -0.01]), bench=1.0)
    assert pos.tolist() == [1.25, 0, 1.25, 1.25, 0]
    assert np.allclose(value, [0.0385, 0.0366875, 0.017375, 0.0168125, 0.0093125])


def test_paths_golden():
    aim = scans.smooth_aim(np.array([1.25, 1.25, 0.5, 0.5, 1, 1]), np.zeros(6), 0.1, 0.02, 1.0, 0.5, 1.12)
    assert np.allclose(aim, [1.10, 1.12, 1.02, 0.92, 1.0, 1.0])
    done = scans.execute(np.array([1.4, 1.4, 1.4, 1.4, 0.1, 0.1]), blend=0.75, hold=1)
    assert np.allclose(done, [1.04, 1.04, 1.08, 1.08, 1.04, 1.04])
    assert np.allclose(scans.execute(np.full(30, 3.0))[-1], 1.12) and np.allclose(scans.execute(np.full(30, -3.0))[-1], 0.5)
    assert scans.min_hold(np.array([1.0, 2, 2, 2, 1]), 3).tolist() == [1, 1, 1, 2, 2]


def test_markers_and_blocks(spark):
    df = frame(spark, ("pos",), [0.7, 0.7, 0.70005, 0.9, 0.4, 0.4])
    assert [r.after for r in diagnostics.trade_markers(df).orderBy("ts").collect()] == [0.9, 0.4]
    df = frame(spark, ("pos",), [1.2, 1.3, 1.04, 0.96, 0.5, 1.0, 0.2])
    assert sorted((r.start, r.end) for r in diagnostics.active_blocks(df).collect()) == [(0, 1), (4, 4), (6, 6)]


def test_holding_runs(spark):
    row = backtest.holding_runs(frame(spark, ("pos",), [1, 1, 0.9, 0.9, 1, 1.1, 1.1, 1, 0.8])).first()
    assert (row.runs, row.mean_hold) == (6, 1.5)


def test_fold_parser_and_month_ends(spark):
    assert folds.parse_folds("5, 1-3,3,2-4") == [5, 1, 2, 3, 4]
    got = folds.splits(spark, datetime(2020, 1, 31), datetime(2021, 1, 1), 1, 1, 1).first()
    assert got.train_end == datetime(2020, 2, 29) and got.val_end == datetime(2020, 3, 29)


def test_regime_memberships(spark):
    row = spark.range(1).select(*(labels.triangular(F.lit(x)).alias(f"x{i}") for i, x in enumerate((0.25, 0.9, 0.0)))).first()
    assert [list(map(lambda v: round(v, 6), r)) for r in row] == [[0.5, 0.5, 0.0], [0.0, 0.2, 0.8], [1.0, 0.0, 0.0]]


def test_deflated_sharpe(spark):
    z = spark.range(1).select(overfit.deflated_sharpe(F.lit(1.5), F.lit(100), F.lit(0.0), F.lit(3.0)).alias("z")).first().z
    assert z == pytest.approx(10.238336262, abs=1e-6)
    assert overfit.upper_tail(0.0) == 0.5


def test_transition_classes(spark):
    cases = [(1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0), (0.5, 1.25), (1.25, 1.0)]
    got = [spark.range(1).select(labels.transition_class(F.lit(a), F.lit(b))).first()[0] for a, b in cases]
    assert got == ["de_risk", "stay_underweight", "recovery", "neutral", "overweight", "neutral"]


@pytest.mark.parametrize("cut", [30, 45])
def test_features_are_causal(spark, cut):
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))
    table = [(c * 0.999, c * 1.01, c * 0.99, c, 5 + i % 7) for i, c in enumerate(close)]
    after = [r if i <= cut else tuple(x * 3 for x in r) for i, r in enumerate(table)]
    names = ("open", "high", "low", "close", "volume")
    build = lambda t: [tuple(r) for r in features.feature_matrix(frame(spark, names, t), 8).orderBy("ts").collect() if r.ts <= datetime(2020, 1, 1) + timedelta(days=cut)]
    assert build(table) == build(after) and len(build(table)) > 10


def test_asof_takes_exact_times(spark):
    day = lambda d: datetime(2020, 1, d)
    grid = spark.createDataFrame([("a", day(d)) for d in (1, 2, 3, 4)], "sym string, ts timestamp_ntz")
    series = spark.createDataFrame([(day(2), 5.0), (day(4), 7.0)], "ts timestamp_ntz, v double")
    got = lambda **k: [r.v for r in align.asof(grid, series, "v", **k).orderBy("ts").collect()]
    assert got() == [None, 5.0, 5.0, 7.0]
    assert got(fill_head=True) == [5.0, 5.0, 5.0, 7.0]
    assert got(zero=True) == [0.0, 5.0, 5.0, 7.0]


def test_klines(spark):
    body = '[[0,"1","3","0.5","2","10",899999,"20",7,"4","8","0"],[900000,"2","3","1","2.5","6",1799999,"12",3,"1","2","0"]]'
    df = bars.klines(spark.createDataFrame([("x", body)], "sym string, body string"), end="1970-01-01 00:15:00")
    row = df.first()
    assert df.count() == 1 and (row.close, row.n_trades, row.taker_buy_base) == (2.0, 7, 4.0)
    assert bars.taker_proxy(df).first().signed_order_flow == pytest.approx(-2.0)


def test_cached_and_series_files(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3).selectExpr("timestamp_ntz'2020-01-01 00:00:00' as time", "cast(id as double) as v")

    path = str(tmp_path / "t_series_oi.parquet")
    assert bars.cached(spark, path, make).count() == 3 and bars.cached(spark, path, make).count() == 3 and len(made) == 1
    assert bars.optional(spark, str(tmp_path / "none.parquet")) is None
    assert "ts" in bars.optional(spark, path).columns


def test_lambda_returns_and_two_hot(spark):
    r, v = [0.5, -1.0], [2.0, 3.0]
    df = spark.createDataFrame([(r, v)], "r array<double>, v array<double>").select(rewards.lambda_returns(F.col("r"), F.col("v"), F.lit(4.0), 0.9, 0.8).alias("g"))
    sl = lambda x: np.sign(x) * np.log1p(abs(x))
    g1 = sl(-1.0) + 0.9 * (0.2 * sl(3.0) + 0.8 * sl(4.0))
    g0 = sl(0.5) + 0.9 * (0.2 * sl(2.0) + 0.8 * g1)
    assert np.allclose(df.first().g, [g0, g1])
    t = spark.range(1).select(rewards.two_hot(F.lit(0.25), -1.0, 1.0, 5).alias("t")).first().t
    assert (t.bin, t.upper) == (2, 0.5)
    s = spark.range(1).select(rewards.soft_label(F.lit(0.25), (0.0, 0.5, 1.0)).alias("s")).first().s
    assert s == [0.5, 0.5, 0.0]


def test_selector_prefers_benchmark_unless_strong(spark):
    rows = [("f", 0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0, False, False, True, None), ("f", 1, 2.0, 1.0, 0.1, -1.0, 0.6, 1.0, False, False, False, None), ("f", 2, 9.0, 4.0, 0.3, -4.0, 0.7, 1.0, True, False, False, "turnover")]
    schema = "fold string, cand int, score double, alpha_pt double, sharpe_delta double, maxdd_pt double, win_rate double, turnover double, m2_pass boolean, stretch_hit boolean, hold boolean, reject string"
    got = selection.choose(spark.createDataFrame(rows, schema), ("fold",)).collect()
    assert [r.cand for r in got] == [0]
    free = spark.createDataFrame([(*r[:-1], None) for r in rows], schema)
    assert selection.choose(free, ("fold",)).first().cand == 0  # four points of alpha are too few
    assert selection.choose(free, ("fold",), active={"alpha": 3.0}).first().cand == 2
    better = spark.createDataFrame([(*r[:3], r[3] * 3, *r[4:-1], None) for r in rows], schema)
    assert selection.choose(better, ("fold",)).first().cand == 2


def test_context_and_impulse_by_hand(spark):
    r = [0.1, -0.2, 0.3, 0.4, -0.5, 0.6]
    out = features.add_context(frame(spark, ("r",), r), (3,)).orderBy("ts").collect()
    assert [x.ctx_mom_3 for x in out[:4]] == [None] * 4  # the window is not whole before
    assert out[4].ctx_mom_3 == pytest.approx(-0.2 + 0.3 + 0.4) and out[5].ctx_mom_3 == pytest.approx(0.3 + 0.4 - 0.5)
    out = features.add_series_stats(frame(spark, ("x",), [4, 1, 1]), "x", (3,)).orderBy("ts").collect()
    assert out[2].x_impulse_3 == pytest.approx(1.0)
    out = features.add_funding_context(frame(spark, ("funding_rate",), [9, 3, 3, 5]), (3,)).orderBy("ts").collect()
    assert out[3].f_impulse_3 == pytest.approx(2.0) and out[3].f_z_3 == pytest.approx(-2 / np.std([9, 3, 3], ddof=1), abs=1e-6)


def test_controller_state_by_hand(spark):
    out = diagnostics.controller_state(frame(spark, ("pos",), [1, 1, 0.8, 0.8, 0.9, 0.9, 1.1]), cap=4, cooldown=2).orderBy("ts").collect()
    assert [r.hold_age for r in out] == [0, 0.25, 0.5, 0, 0.25, 0, 0.25]
    assert [r.under_age for r in out] == [0, 0, 0, 0.25, 0.5, 0.75, 1]
    assert [r.cooldown for r in out] == [0, 0, 0, 0, 0, 0.5, 0.25]


def test_smooth_aim_confirms_and_scales_steps():
    kept = dict(step=0.4, band=0.0, start=1.0, low=0.0, high=1.5, confirm=4)
    path = scans.smooth_aim(np.array([0.5, 0.5, 2.0]), np.array([2.0, 1, 0]), **kept)
    assert np.allclose(path, [0.75, 0.75, 1.15])  # half confirmed by the two bars to come; whole steps
    slow = scans.smooth_aim(np.array([0.0, 0.0, 1.0]), np.array([2.0, 1, 0]), **kept, step_scale=0.0, floor=0.7)
    assert np.allclose(slow, [0.8, 0.7, 1.0])
    assert scans.smooth_aim(np.array([1.0]), np.zeros(1), 0.1, 0.05, 9.0, 0.0, 1.2)[0] == pytest.approx(1.1)  # the start is bounded


def test_overlay_chain_by_hand():
    out = scans.overlay_chain(np.array([1.1, 1.1, 0.9]), alpha=1.0, hold_band=0.05, dead=0.02, step=0.06)
    assert np.allclose(out, [1.06, 1.1, 1.04])
    gate = np.array([0.5])
    assert np.allclose(scans.overlay_chain(np.array([0.9]), alpha=1.0, hold_band=0, dead=0, step=1, gate=gate, down_cut=0.4, up_add=0.1), [0.92])
    assert np.allclose(scans.regime_hold(np.array([0.1, 0.3, 0.3, 0.3]), 2, 0.05), [0.1, 0.1, 0.1, 0.3])


def test_execution_grid_is_each_setting_alone():
    target = np.random.default_rng(5).uniform(0.2, 1.5, 80)
    specs = [(0.5, 0.04, 3), (1.0, 0.1, 0), (0.25, 0.01, 16)]
    for got, (blend, step, hold) in zip(scans.execute_grid(target, specs), specs):
        assert np.allclose(got, scans.execute(target, blend, hold, step))


def test_differential_sharpe_by_hand():
    got = scans.differential_sharpe(np.array([0.5, -0.25]), 0.1)
    a, b = 0.05, 0.025
    assert got[0] == 0 and got[1] == pytest.approx((b * (-0.25 - a) - 0.5 * a * (0.0625 - b)) / (b - a * a + 1e-8) ** 1.5)


def test_folds_of_no_deviation_score_nothing(spark):
    scores = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 0.25), (3, -1.0)], "fold int, score double")
    row = overfit.pbo(scores).first()
    assert row.subsets == 6 and row.pbo == pytest.approx(0.5)
    assert overfit.pbo(scores.limit(1)).first().pbo == 0.5


def test_tail_of_the_normal_distribution(spark):
    zs = [-3.0, -0.7, 0.0, 0.4, 2.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(overfit.p_value(F.col("z")).alias("p")).collect()
    assert np.allclose([r.p for r in got], [overfit.upper_tail(z) for z in zs], atol=1e-6)


def test_sources_by_hand(spark, tmp_path):
    spark.sql("select timestamp_ntz'2020-01-01' as time, cast(null as double) as a, 2D as b").write.parquet(str(tmp_path / "t_series_x.parquet"))
    spark.sql("select timestamp_ntz'2020-01-02' as ts, 5D as other").write.parquet(str(tmp_path / "t_series_y.parquet"))
    got = {(r.series, r.value) for r in bars.series_files(spark, f"{tmp_path}/t_series_*.parquet").collect()}
    assert got == {("x", None), ("y", 5.0)}
    assert bars.series_files(spark, f"{tmp_path}/t_series_*.parquet", ["y"]).count() == 1
    body = '[{"timestamp": 900000, "buyVol": "3", "sellVol": "1", "buySellRatio": "3.0"}, {"timestamp": 0, "buyVol": "1", "sellVol": "1", "buySellRatio": "1.0"}]'
    rows = bars.long_short_ratio(spark.createDataFrame([("s", body)], "sym string, body string")).collect()
    assert [round(r.imbalance, 6) for r in rows] == [0.0, 0.5]
    made = []

    def make():
        made.append(1)
        return spark.sql("select 'a' as sym, id as ts, id as f from range(4)"), spark.sql("select 'a' as sym, id as ts, id as ret from range(2, 7)")

    for _ in (1, 2):
        features_, returns = bars.cached_pair(spark, str(tmp_path / "pair"), make)
        assert features_.count() == returns.count() == 2 and len(made) == 1
    assert bars.union_symbols({"p": spark.range(2), "q": spark.range(1)}).groupBy("sym").count().count() == 2
    assert spark.range(1).select(bars.millis(F.lit("1970-01-01 00:01:00"))).first()[0] == 60000


def test_hidden_states_are_found():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.2, 80) for m in (-1, 2, 0, -1)])
    _, move, mean, _ = scans.fit_hmm(x)
    assert np.allclose(mean, [-1, 0, 2], atol=0.15) and np.allclose(move.sum(axis=1), 1) and (np.diag(move) > 0.9).all()
    p = np.stack(scans.regimes(x), axis=1)
    assert (p.argmax(axis=1) == np.repeat([0, 2, 1, 0], 80)).mean() > 0.97


def test_hidden_states_add_up():
    p = scans.forward_backward(np.array([-1.0, -1, 1, 1]), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([-1.0, 1]), np.array([0.5, 0.5]))
    assert np.allclose(p.sum(axis=1), 1) and p[0, 0] > 0.9 and p[-1, 1] > 0.9


def test_empty_rows(spark):
    df = frame(spark, ("ret", "pos"), [])
    assert backtest.full(df).count() == 0 and diagnostics.maxdd_interval(df).count() == 0
    assert scans.scan(df, scans.execute, ("pos",), ("out",)).count() == 0


def test_pbo_takes_every_fold(spark):
    """sf0.01 has 17 folds."""
    duckdb = pytest.importorskip("duckdb")
    from barline import plans

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    want = db.execute(plans.ORACLES["q_pbo"]).fetchone()
    got = plans.QUERIES["q_pbo"](spark, sf).first()
    assert want[1] == got.subsets == 24310 and abs(want[0] - got.pbo) < 1e-6


def test_knn_anchors_span_the_table(spark):
    """The bank is spaced over all ids."""
    duckdb = pytest.importorskip("duckdb")
    from barline import plans

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    ids = sorted(r[0] for r in db.execute("SELECT vec_id FROM embeddings").fetchall())
    bank = [ids[k] for k in np.linspace(0, len(ids) - 1, num=32, dtype=np.int64)]
    want = db.execute(plans.ORACLES["q_knn_anchor"]).fetchall()
    assert {a for _, a, _ in want} <= set(bank)
    got = [tuple(r) for r in plans.QUERIES["q_knn_anchor"](spark, sf).select("vec_id", "anchor", "distance").collect()]
    assert len(got) == len(ids) and sorted((i, a, f"{d:.4f}") for i, a, d in got) == sorted((i, a, f"{d:.4f}") for i, a, d in want)
    assert max(a for _, a, _ in got) > 31
    assert rewards.anchor_bank(spark.range(7).withColumnRenamed("id", "vec_id"), 32).count() == 7


def test_run_specs():
    assert folds.parse_run("a=runs/x") == {"label": "a", "dir": "runs/x", "file": "ac.pt", "mode": "ac"}
    assert folds.parse_run("b=/r:1/x@y.pt:bc") == {"label": "b", "dir": "/r:1/x", "file": "y.pt", "mode": "bc"}
    assert folds.parse_run("c=d=e@f@g") == {"label": "c", "dir": "d=e@f", "file": "g", "mode": "ac"}
    for wrong in ("", "a", "=x", "a=", "a=@f", "a=d@", "a=:bc"):
        with pytest.raises(ValueError):
            folds.parse_run(wrong)


def test_days_to_bars():
    assert [features.days_to_bars(2, i) for i in ("1d", "1h", "15m", "1m", "?")] == [2, 48, 192, 2880, 192]


def test_mark_prices(spark):
    row = lambda ms, close: [ms, "1", "2", "0.5", close, "9", 0, "0", 3, "0", "0", "0"]
    body = json.dumps([row(0, "1.25"), row(900_000, "1.5")])
    got = bars.mark_klines(spark.createDataFrame([("a", body)], "sym string, body string")).orderBy("ts").collect()
    assert [(r.sym, r.ts.minute, r.mark_close) for r in got] == [("a", 0, 1.25), ("a", 15, 1.5)]


def test_hyperbolic_and_rounding(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (2.5,), (-0.5,), (None,)], "x double")
    got = rows.select(F.tanh("x"), scalar.clipped_atanh(F.col("x")), F.rint("x")).collect()
    assert got[1][0] == pytest.approx(math.tanh(0.5)) and got[1][1] == pytest.approx(math.atanh(0.5)) and math.isfinite(got[2][1])
    assert [r[2] for r in got] == [0.0, 0.0, 2.0, 0.0, None] and got[4][1] is None


def test_pair_is_worked_out_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        left = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2)], "sym string, ts int, x double")
        return left, left.where("ts > 1").withColumnRenamed("x", "ret")

    for _ in range(2):
        features_, returns = bars.cached_pair(spark, f"file://{tmp_path}", make)
        assert features_.count() == returns.count() == 1
    assert made == [1]


def test_long_windows_by_prefix_sums(spark):
    """The two ways to a z-score agree, over nulls, constants, block borders and levels far from 0."""
    rng = np.random.default_rng(7)
    rows = []
    for sym, n in (("a", 70), ("b", 9), ("c", 1)):
        for t in range(n):
            x = None if t % 11 == 3 else float(rng.normal(1e6, 5))
            rows.append((sym, t, x, 7.0 if t < 40 else float(t % 3), None if sym == "b" else float(rng.normal())))
    df = spark.createDataFrame(rows, "sym string, ts int, x double, y double, z double").repartition(3)
    for n in (5, 8, 24):
        plain = features.zscores(df, ["x", "y", "z"], n).orderBy("sym", "ts").collect()
        long = features.zscores(df, ["x", "y", "z"], n, long=1).orderBy("sym", "ts").collect()
        for a, b in zip(plain, long):
            assert a[:2] == b[:2] and [v is None for v in a] == [v is None for v in b]
            np.testing.assert_allclose([v or 0.0 for v in b[2:]], [v or 0.0 for v in a[2:]], atol=1e-6)
