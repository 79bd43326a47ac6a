"""Typed streaming state gives what the batch operators give, across batches and restarts."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from barline.operators import diagnostics, rewards
from barline.streaming import live, states


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(states.STATE_STORE[0])
    spark.conf.set(*states.STATE_STORE)
    yield spark
    spark.conf.set(states.STATE_STORE[0], before)


def run(spark, tmp_path, parts, schema, made):
    """Each part is another run of the query on the same checkpoint."""
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.append(made(stream), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_controller_state_is_carried(rocks, tmp_path):
    rng = np.random.default_rng(8)
    start = datetime(2021, 1, 1)
    rows = [(s, start + timedelta(hours=t), float(rng.choice([0.5, 0.5, 0.9, 1.0, 1.0, 1.1]))) for s in "ab" for t in range(60)]
    parts = [[r for r in rows if lo <= (r[1] - start).total_seconds() / 3600 < hi] for lo, hi in ((0, 17), (17, 18), (18, 60))]
    schema = "sym string, ts timestamp, pos double"
    out = run(rocks, tmp_path, parts, schema, lambda s: states.live_controller(s, cap=8, cooldown=5))
    names = ("over", "delta", "hold_age", "under_age", "cooldown")
    want = diagnostics.controller_state(rocks.createDataFrame(rows, schema), cap=8, cooldown=5).orderBy("sym", "ts").collect()
    got = out.orderBy("sym", "ts").collect()
    assert [(r.sym, r.ts) for r in got] == [(r.sym, r.ts) for r in want]
    np.testing.assert_allclose([[r[n] for n in names] for r in got], [[r[n] for n in names] for r in want], atol=1e-12)
    assert max(r.cooldown for r in got) > 0 and max(r.under_age for r in got) > 0.2


def test_reward_scale_closes_batches(rocks, tmp_path):
    rng = np.random.default_rng(9)
    start = datetime(2021, 1, 1)
    rows = [(k, start + timedelta(minutes=10 * b + i), b, float(rng.normal(0, 3 + b))) for k in "ab" for b in range(5) for i in range(9)]
    parts = [[r for r in rows if r[2] < 2 or (r[2] == 2 and r[1].minute % 10 < 4)], [r for r in rows if r[2] > 2 or (r[2] == 2 and r[1].minute % 10 >= 4)]]
    parts.append([("z", start + timedelta(days=1), 0, 1.0)])  # time goes on: the timers of the last batches run out
    schema = "key string, ts timestamp, batch long, value double"
    got = {(r.key, r.batch): (r.low, r.high, r.scale) for r in run(rocks, tmp_path, parts, schema, states.live_reward_scale).where("key <> 'z'").collect()}
    want = {(r.key, r.batch): (r.low, r.high, r.scale) for r in rewards.reward_scale(rocks.createDataFrame(rows, schema), "value", by=("key",)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
