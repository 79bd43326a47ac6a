"""Rollouts, hidden states, boosted allocators, bundles, sampled subsets: hand-worked cases, brute force, plain NumPy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import boosting, evaluate, folds, labels, overfit, regimes, rollout, teachers
from barline.sources import bundles

# --- rollout


def path(signal, target, band=0.0, **settings):
    n = max(np.size(signal), np.size(target))
    return rollout.closed_loop(*(np.broadcast_to(np.asarray(x, dtype=float), n) for x in (signal, target, band)), **settings)


def test_rollout_by_hand():
    # a very steep band gate is 1 outside the band: each step closes half of the gap
    position, forced = path(0.5, [0.1, 0.1, -0.4, 0.0], slope=1e4)
    np.testing.assert_allclose(position, [1.05, 1.075, 0.8375, 0.91875], atol=1e-12)
    assert not forced.any()
    # inside the band nothing moves, steps are limited, bounds hold
    np.testing.assert_allclose(path(1.0, [0.02, 0.1, -9.0, -9.0], 0.05, slope=1e4, step=0.3)[0], [1.0, 1.1, 0.8, 0.5], atol=1e-9)
    # grid, then snap to the benchmark
    np.testing.assert_allclose(path(1.0, [0.034, 0.012, 0.006], slope=1e4, grid=0.01, snap=0.015)[0], [1.03, 1.0, 1.0], atol=1e-12)
    # a gap boost adds tanh of the distance beyond the band, to 1 at most
    assert rollout.adjustment_rate(0.2, 0.3, 0.1, boost=0.5) == pytest.approx(0.2 + 0.5 * math.tanh(2.0))
    assert rollout.adjustment_rate(0.9, -5.0, 0.0, boost=0.5) == 1.0 and rollout.adjustment_rate(-1.0, 1.0, 0.1) == 0.0


def test_rollout_caps():
    # half of the bars at most, rounded up: bars 1, 3, 5 stay, the others become the benchmark, from which the next starts
    position, forced = path(1.0, -0.2, slope=1e4, active=0.5)
    position, forced = path(np.ones(6), np.full(6, -0.2), slope=1e4, active=0.5)
    np.testing.assert_allclose(position, [0.8, 1.0] * 3, atol=1e-12)
    assert forced.tolist() == [0, 1] * 3
    # each side has its own count
    position, _ = path(1.0, [-0.2, -0.2, 0.1, 0.1, 0.1, -0.2], slope=1e4, under=0.2, over=0.5)
    np.testing.assert_allclose(position, [0.8, 1.0, 1.1, 1.1, 1.1, 0.8], atol=1e-12)
    assert len(path([], [])[0]) == 0


def test_rollout_on_groups(spark):
    rows = [(s, t, 1.0, -0.2 if t % 2 else 0.1, 0.01) for s in "ab" for t in range(9)]
    df = rollout.rollout(spark.createDataFrame(rows, "sym string, ts int, signal double, target double, band double").repartition(3), active=0.5)
    got = [r.position for r in df.where("sym = 'b'").orderBy("ts").collect()]
    np.testing.assert_allclose(got, rollout.closed_loop(*(np.array(c) for c in zip(*((s, t, b) for *_, s, t, b in rows[:9]))), active=0.5)[0])


# --- hidden states


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(5):
        k, n = 3, 6
        start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
        mean, std, x = rng.normal(0, 1, k), rng.uniform(0.3, 1, k), rng.normal(0, 1, n)
        like = -0.5 * ((x[:, None] - mean) / std) ** 2 - np.log(std)
        worth = lambda p: np.log(start[p[0]]) + sum(like[t, s] for t, s in enumerate(p)) + sum(np.log(move[a, b]) for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert tuple(regimes.viterbi(x, start, move, mean, std)) == max(itertools.product(range(k), repeat=n), key=worth)
    assert len(regimes.viterbi(np.array([]), start, move, mean, std)) == 0
    assert regimes.viterbi(np.array([0.0, 0.0]), np.array([1.0, 0.0]), np.eye(2), np.zeros(2), np.ones(2)).tolist() == [0, 0]


def test_decoded_learns_from_training_rows_only(spark):
    rng = np.random.default_rng(3)
    calm, wild = rng.normal(-1.0, 0.1, 60), rng.normal(1.0, 0.1, 60)
    train = [("a", 0, t, float(x), "train") for t, x in enumerate(np.r_[calm, wild])]
    test = [("a", 0, 200 + t, float(x), "test") for t, x in enumerate([-1.0, -1.1, 1.0, 0.9])]
    df = spark.createDataFrame(train + test + [("a", 0, 300, None, "test"), ("b", 0, 1, 0.1, "train"), ("b", 0, 2, 0.1, "test")], "sym string, fold int, ts int, ret double, role string")
    out = regimes.decoded(df, states=2).orderBy("sym", "ts").collect()
    assert [r.state for r in out] == [0, 0, 1, 1, None, None] and out[0].p0 > 0.99
    other = regimes.decoded(df.withColumn("ret", F.when(F.col("ts") == 203, 50.0).otherwise(F.col("ret"))), states=2).orderBy("sym", "ts").collect()
    assert [r.state for r in other[:3]] == [0, 0, 1]  # a test row doesn't move the model


# --- boosted trees


def numpy_boosted(bins, y, train, k):
    """The same trees on the same bins, in plain loops."""
    total = np.full(len(y), y[train].mean())
    for _ in range(k["trees"]):
        rest, node = y - total, np.ones(len(y), dtype=int)
        for _ in range(k["depth"]):
            after = node.copy()
            for v in np.unique(node[train]):
                here, best = train & (node == v), (0.0, None)
                score = lambda m: rest[m].sum() ** 2 / (m.sum() + k["penalty"])  # noqa: E731, B023
                for f in range(bins.shape[1]):
                    for b in np.unique(bins[here, f]):
                        left, right = here & (bins[:, f] <= b), here & (bins[:, f] > b)
                        if min(left.sum(), right.sum()) >= k["least"]:
                            gain = round(score(left) + score(right) - score(here), 12)
                            if gain > best[0]:
                                best = gain, (f, b)
                if best[1]:
                    f, b = best[1]
                    after[node == v] = 2 * v + (bins[node == v, f] > b)
            node = after
        for v in np.unique(node):
            m = train & (node == v)
            if m.any():
                total[node == v] += k["rate"] * rest[m].sum() / (m.sum() + k["penalty"])
    return total


def test_boosted_equals_numpy(spark):
    rng = np.random.default_rng(6)
    k = {"bins": 8, "trees": 3, "depth": 2, "rate": 0.3, "least": 5, "penalty": 1.0}
    rows, want = [], {}
    for sym in ("a", "b"):
        x = np.round(rng.normal(0, 1, (160, 3)), 1)
        y, train = np.where(x[:, 1] > 0.2, 1.0, 0.0) + 0.3 * x[:, 0] + rng.normal(0, 0.1, 160), np.arange(160) < 110
        x[::17, 2] = np.nan
        edges = [np.quantile(x[train & ~np.isnan(x[:, f]), f], np.arange(1, 8) / 8) for f in range(3)]
        bins = np.column_stack([np.where(np.isnan(x[:, f]), 8, (x[:, f][:, None] > edges[f]).sum(axis=1)) for f in range(3)])
        want[sym] = numpy_boosted(bins, y, train, k)
        rows += [(sym, i, *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i]), bool(train[i]), "old") for i in range(160)]
    df = spark.createDataFrame([*rows, ("c", 0, 1.0, 1.0, 1.0, 1.0, False, "old")], "sym string, i int, u double, v double, w double, y double, train boolean, predicted string").repartition(4)
    got = boosting.boosted(df, ("u", "v", "w"), "y", "train", by=("sym",), **k)
    for sym in want:
        np.testing.assert_allclose([r.predicted for r in got.where(F.col("sym") == sym).orderBy("i").collect()], want[sym], atol=1e-9)
    assert got.where("sym = 'c'").first().predicted is None and got.count() == len(rows) + 1


# --- bundles


def test_bundles_round_trip_and_damage(spark, tmp_path):
    for fold, n in ((0, 5), (3, 2)):
        np.savez(tmp_path / f"fold{fold:02d}_teacher.npz", train_positions=np.linspace(0, 1, n), val_positions=np.ones(1, dtype=np.float32), **({"source_id": np.array([7])} if fold else {}))
    rows = bundles.teachers(spark, f"file://{tmp_path}").orderBy("fold", "role", "i").collect()
    assert [(r.fold, r.role, r.i, r.source_id) for r in rows] == [*((0, "train", i, -1) for i in range(5)), (0, "val", 0, -1), (3, "train", 0, 7), (3, "train", 1, 7), (3, "val", 0, 7)]
    assert [r.position for r in rows[:5]] == [0.0, 0.25, 0.5, 0.75, 1.0]
    whole = (tmp_path / "fold00_teacher.npz").read_bytes()
    for damaged in (b"", whole[:60], whole.replace(b"NUMPY", b"NUMPX"), whole.replace(b"descr", b"desxr")):
        with pytest.raises(ValueError, match="some file"):
            bundles.members(damaged, "some file")
    text = tmp_path / "text.npz"
    np.savez(text, names=np.array(["a"]))
    with pytest.raises(ValueError, match="not numbers"):
        bundles.members(text.read_bytes())
    table = np.arange(6.0).reshape(2, 3)
    np.savez_compressed(text, table=table, none=np.zeros((0, 4)), one=np.array(2, dtype=np.int8))
    got = bundles.unpacked(spark.createDataFrame([("x", bytearray(text.read_bytes())), ("y", None)], "key string, content binary"), keep=("key",)).collect()
    assert sorted((r.key, r.name, tuple(r.shape), r.i, r.value) for r in got) == [("x", "one", (), 0, 2.0), *(("x", "table", (2, 3), i, float(i)) for i in range(6))]


# --- subsets


def test_subsets_are_numbered():
    for n, k in ((6, 3), (7, 2), (5, 0)):
        assert sorted(tuple(sorted(overfit.unranked(r, n, k))) for r in range(math.comb(n, k))) == sorted(itertools.combinations(range(n), k))
    assert len(overfit.unranked(math.comb(300, 150) - 1, 300, 150)) == 150


def test_pbo_exact_and_sampled(spark):
    rng = random.Random(1)
    scores = [rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(9)]
    table = lambda xs: spark.createDataFrame(list(enumerate(xs)), "fold int, score double")
    wins = [max(scores[i] for i in c) > max(scores[i] for i in range(9) if i not in c) for c in itertools.combinations(range(9), 4)]
    exact = overfit.pbo(table(scores)).first()
    assert exact.subsets == len(wins) and exact.pbo == pytest.approx(sum(wins) / len(wins))
    many = [rng.gauss(0, 1) for _ in range(80)]  # more subsets than a long counts
    first, again, other = (overfit.pbo(table(many), exact=10, sample=200, seed=s).first() for s in (5, 5, 6))
    assert first == again and first.subsets == 200 and 0.3 < first.pbo < 0.7 and other.subsets == 200
    assert overfit.pbo(table([1.0])).first().pbo == 0.5


# --- vectors and windows


def test_vector_signal(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([1.0],), ([float("nan"), 1.0, 1.0],), ([None, 1.0, 1.0],), (None,)], "v array<double>")
    got = [(r.s, r.k) for r in df.select(teachers.vector_signal(F.col("v"), (0, 2, 9)).alias("s"), teachers.risk_state(F.col("v"), (0, 2), 1.0, 2.0).alias("k")).collect()]
    assert got == [(3.5, 5.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    gate = spark.range(1).select(teachers.risk_gate(F.lit(1e9), 0.0, 1.0, 0.2).alias("a"), teachers.risk_gate(F.lit(0.0), 0.0, 1.0, 0.2).alias("b")).first()
    assert gate.a == pytest.approx(1.0) and gate.b == pytest.approx(0.6)


def test_folds_are_selected(spark):
    table = spark.createDataFrame([(k, 10 * k) for k in range(5)], "fold int, x int")
    assert sorted(r.x for r in folds.select(table, "0-1,3,1").collect()) == [0, 10, 30]
    assert folds.select(table).count() == 5 and folds.select(table, [4]).first().x == 40
    for wrong in ("", "3-6", [9]):
        with pytest.raises(ValueError):
            folds.select(table, wrong)


def test_distinct_values(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "z"), ("a", 2, "x"), ("a", 0, None), ("b", 5, None)], "sym string, ts int, v string")
    assert [(r.sym, r["values"]) for r in evaluate.distinct_values(df, "v").collect()] == [("a", ["z", "x"])]
    assert evaluate.distinct_values(df, "v", sort=True).first()["values"] == ["x", "z"]


def test_path_windows(spark):
    df = spark.createDataFrame([("a", t, None if t == 1 else float(t), 10.0 + t) for t in range(4)] + [("b", 0, 1.0, 1.0)], "sym string, ts int, x double, pos double")
    got = labels.path_windows(df, ("x",), 3).orderBy("ts").collect()
    assert [(r.sym, r.ts, r.start, r.x_path) for r in got] == [("a", 0, 10.0, [0.0, None, 2.0]), ("a", 1, 11.0, [None, 2.0, 3.0])]
