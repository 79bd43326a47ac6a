"""Exact quantiles, places, as-of joins and fingerprints."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import align, evaluate, rewards
from barline.operators.quantiles import at_places, quantiles, with_quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("kind", ["spread", "ties", "one value"])
def test_quantiles_equal_duckdb(spark, kind):
    rng = random.Random(3)
    value = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 3)), "one value": lambda: 2.5}[kind]
    rows = [(g, None if rng.random() < 0.1 else value()) for g, n in (("a", 997), ("b", 2), ("c", 1), ("d", 40)) for _ in range(n)] + [("nulls", None)]
    df = spark.createDataFrame(rows, "sym string, x double").repartition(5)
    got = {r.sym: r._q for r in quantiles(df, "x", SHARES).collect()}
    pdf = df.toPandas()  # noqa: F841
    want = {r[0]: list(r[1:]) for r in duckdb.sql(f"SELECT sym, {', '.join(f'quantile_cont(x, {s})' for s in SHARES)} FROM pdf WHERE x IS NOT NULL GROUP BY sym").fetchall()}
    assert got.keys() == want.keys() and "nulls" not in got
    for g in want:
        np.testing.assert_allclose(got[g], want[g], rtol=1e-12, atol=1e-12)
    whole = quantiles(df, F.col("x"), (0.5,), ()).first()._q
    assert whole[0] == pytest.approx(np.median([x for _, x in rows if x is not None]))
    assert with_quantiles(df, "x", (0.5,)).where("_q is null").select("sym").distinct().collect()[0].sym == "nulls"
    assert quantiles(df.limit(0), "x", (0.5,)).count() == 0


def test_places(spark):
    df = spark.createDataFrame([(i % 50, i % 3) for i in range(300)] + [(None, 1)], "id int, mark int")
    ordered = sorted([(None, 1), *((i % 50, i % 3) for i in range(300))], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    places = [0, 1, 2, 150, 299, 300]
    assert {tuple(r) for r in at_places(df, ("id", "mark"), places).collect()} == {ordered[p] for p in places}


def test_bank_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, [float(i), 1.0]) for i in range(6)] + [(2, [9.0, 9.0])] * 4, "vec_id long, embedding array<float>").repartition(3)
    bank = rewards.anchor_bank(df, 4)
    assert bank.count() == 3 and bank.where("vec_id = 2").count() == 1 and bank.columns == df.columns  # places 6 and 9 are equal rows
    assert rewards.anchor_bank(df, 10).count() == 10


def _asof(bars, points, fill_head):
    out = []
    for sym, t in bars:
        mine = [(u, v) for s, u, v in points if v is not None and s in (None, sym)]
        before = [p for p in mine if p[0] <= t]
        out.append((sym, t, max(before)[1] if before else min(mine, key=lambda p: (p[0], -p[1]))[1] if mine and fill_head else None))
    return sorted(out)


@pytest.mark.parametrize("fill_head", [False, True])
@pytest.mark.parametrize("by_symbol", [False, True])
@pytest.mark.parametrize("width", [1, 10, 1000])
def test_asof(spark, by_symbol, fill_head, width):
    rng = random.Random(width)
    bars = [(s, t) for s in ("a", "b", "c") for t in rng.sample(range(200), 40)]
    points = [(rng.choice("ab") if by_symbol else None, t, rng.choice([None, float(t)])) for t in rng.sample(range(30, 150), 12)]
    to_time = F.timestamp_seconds("t").alias("ts")
    left = spark.createDataFrame(bars, "sym string, t long").select("sym", to_time, "t", F.lit(1).alias("x"))
    right = spark.createDataFrame(points, "sym string, t long, v double").select(*(["sym"] if by_symbol else []), to_time, F.col("v").alias("x"))
    got = sorted((r.sym, r.t, r.x) for r in align.asof(left, right, "x", fill_head=fill_head, width=width).collect())
    assert got == _asof(bars, points, fill_head)
    assert {r.x for r in align.asof(left, right.limit(0), "x", zero=True).collect()} == {0.0}
    plan = align.asof(left, right, "x")._sc._jvm.PythonSQLUtils.explainString(align.asof(left, right, "x")._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan


def test_fingerprint(spark):
    rows = [(t, f"n{t % 3}", float(t)) for t in range(40)]
    make = lambda r, parts=3: spark.createDataFrame(r, "ts long, a string, b double").repartition(parts)
    digest = lambda df: evaluate.fingerprint(df, width=7).first().digest
    base = digest(make(rows))
    assert digest(make(rows[::-1], 1)) == base
    assert evaluate.fingerprint(make(rows), width=7).first().rows == 40
    swapped = [(1 - t if t < 2 else t, a, b) for t, a, b in rows]
    others = [rows + rows[:1], rows + rows[:1] * 2, rows[1:], swapped, [(t, a, None if t == 3 else b) for t, a, b in rows], rows + [(5, None, 1.0)], rows + [(5, "-", 1.0)], rows + [(5, "null", 1.0)]]
    assert len({base, *(digest(make(o)) for o in others)}) == len(others) + 1
    two = lambda a, b: spark.createDataFrame([(1, a, b)], "ts long, a string, b string")
    assert digest(two("a|b", "c")) != digest(two("a", "b|c")) and digest(two("1:a", "")) != digest(two("", "1:a"))
    assert evaluate.fingerprint(make([])).collect() == [] or evaluate.fingerprint(make([])).first().rows is None
