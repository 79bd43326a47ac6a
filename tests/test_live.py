"""Streams give what the batch operators give; weights on literal fixtures."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import scalar
from barline.operators import scans, weights
from barline.sources import bars
from barline.streaming import live

from .conftest import SF


def test_live_bars_are_batch_bars(spark, tmp_path):
    events = bars.read(spark, SF, "events")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live.append(live.live_bars(stream), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {(r.sym, r.ts): (r.open, r.high, r.low, r.close) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.sym, r.ts): (r.open, r.high, r.low, r.close) for r in bars.bars_15m(spark, SF).collect()}
    last = max(ts for _, ts in want)
    closed = {k: v for k, v in want.items() if k[1] < last - timedelta(hours=2)}
    assert got and set(closed) <= set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)


def test_live_execution_carries_state(spark, tmp_path):
    target = np.array([2.0, 2, -1, -1, 0.5, 1.1, 1.1, 0.2])
    rows = [("a", datetime(2020, 1, 1) + timedelta(days=i), float(x)) for i, x in enumerate(target)]
    for k in (0, 4):
        spark.createDataFrame(rows[k : k + 4], "sym string, ts timestamp, target double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sym string, ts timestamp, target double").parquet(str(tmp_path / "in"))
        live.append(live.live_execution(stream), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = [r.pos for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]
    assert got == pytest.approx(scans.execute(target).tolist())


def test_weights(spark):
    rows = [("a", datetime(2020, 1, 1 + i), p, e) for i, (p, e) in enumerate([(1.0, -1.0), (1.0, 0.0), (0.5, 1.0), (0.5, 2.0), (0.5, 3.0)])]
    df = spark.createDataFrame(rows, "sym string, ts timestamp_ntz, pos double, edge double")
    quality = [r.quality for r in weights.quality_weights(df, "edge").orderBy("ts").collect()]
    assert quality == pytest.approx([0, 0, 0, 0, 0.5 / 0.3])
    chunk = weights.chunk_actions(df).collect()
    assert [(r.chunk, r.current, r.action) for r in chunk] == [(0, 1.0, 0.5)]
    trade = weights.trade_weight(df).first()
    assert (trade.trades, trade.others, trade.weight) == (1, 4, 4.0)
    shares = [r.weight for r in weights.class_weights(df, F.when(F.col("pos") < 1, 0).otherwise(1), 2).orderBy("class").collect()]
    assert shares == pytest.approx([0.8, 1.2])
    assert not weights.quality_weights(df.limit(0), "edge").count()
    assert weights.quality_weights(df.limit(2), "edge").agg(F.sum("quality")).first()[0] == 0


def test_scalars(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(0.0,), (800.0,), (None,), (float("nan"),)], "x double")
    out = rows.select(scalar.sigmoid(x), scalar.softplus(x), scalar.bucketize(x, (-1.0, 0.0, 1.0)), scalar.one_hot(F.lit(1), 3), scalar.finite_or(x)).collect()
    assert out[0][:3] == (0.5, pytest.approx(np.log(2)), 1) and out[0][3] == [0, 1, 0]
    assert out[1][:3] == (1.0, 800.0, 3)
    assert out[2][0] is None and out[2][2] is None
    assert [r[4] for r in out] == [0, 800, 0, 0]
    assert scalar.run_id({"a": 1, "b": 2}) == scalar.run_id({"b": 2, "a": 1})
