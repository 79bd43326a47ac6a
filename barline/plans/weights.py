"""Queries on weights, chunks and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.frames import round_to
from barline.functions import scalar
from barline.operators import labels, weights
from barline.plans.paths import _ACTIONS, _VALUES, W, _value, rows
from barline.plans.views import ROWS


def _edges(spark, sf):
    return rows(spark, sf).withColumn("edge", (F.col("pos") - 1) * F.col("ret"))


def q_sample_quality(spark, sf):
    return round_to(weights.quality_weights(_edges(spark, sf), "edge").select("sym", "ts", "quality"))


def q_quality_modes(spark, sf):
    df = _edges(spark, sf)
    df = df.withColumns({"under": weights.quality_edge("underweight_edge", "ret", "edge"), "size": weights.quality_edge("abs_signal", "ret", "edge")})
    return round_to(weights.quality_weights(df, "under", "quality").select("sym", "ts", "size", "quality"))


def q_weighted_values(spark, sf):
    df = labels.transition_values(rows(spark, sf), weights=(1, 3))
    return round_to(df.select("sym", "ts", *(F.col("values")[i].alias(f"a{i}") for i in range(4))))


def q_advantage_scale(spark, sf):
    return round_to(weights.advantage_scale(_edges(spark, sf), "edge").select("sym", "ts", "advantage"))


def q_class_weights(spark, sf):
    label = F.when(F.col("ret") < -0.004, 0).when(F.col("ret") > 0.004, 2).otherwise(1)
    return round_to(weights.class_weights(rows(spark, sf), label, 4))


def q_trade_weight(spark, sf):
    return round_to(weights.trade_weight(rows(spark, sf)))


def q_chunk_actions(spark, sf):
    return round_to(weights.chunk_actions(rows(spark, sf)))


def q_scalars(spark, sf):
    x = F.col("ret") * 100
    shares = scalar.softmax(F.array(x, F.col("pos"), F.lit(0.0)))
    return round_to(rows(spark, sf).select("sym", "ts", scalar.sigmoid(x).alias("sig"), scalar.softplus(x).alias("soft"), shares[0].alias("share"), scalar.bucketize(x, (-0.5, 0.0, 0.5)).alias("bucket")))


QUERIES = {f.__name__: f for f in (q_sample_quality, q_quality_modes, q_weighted_values, q_advantage_scale, q_class_weights, q_trade_weight, q_chunk_actions, q_scalars)}

_EDGE = f"{ROWS}, e AS (SELECT *, (pos - 1) * ret AS edge FROM rows), q AS (SELECT sym, quantile_cont(edge, 0.75) FILTER (edge > 0) AS a, quantile_cont(edge, 0.9) FILTER (edge > 0) AS b FROM e GROUP BY sym)"
ORACLES = {
    "q_sample_quality": f"{_EDGE} SELECT sym, ts, round(CASE WHEN a IS NULL THEN 0.0 ELSE greatest(0, least(4, (edge - a) / greatest(b - a, 1e-6))) END, 6) AS quality FROM e JOIN q USING (sym)",
    "q_quality_modes": f"{ROWS}, e AS (SELECT *, greatest(1 - pos, 0) * greatest(-(pos - 1) * ret, 0) AS u FROM rows), q AS (SELECT sym, quantile_cont(u, 0.75) FILTER (u > 0) AS a, quantile_cont(u, 0.9) FILTER (u > 0) AS b FROM e GROUP BY sym) SELECT sym, ts, round(abs(ret), 6) AS size, round(CASE WHEN a IS NULL THEN 0.0 ELSE greatest(0, least(4, (u - a) / greatest(b - a, 1e-6))) END, 6) AS quality FROM e JOIN q USING (sym)",
    "q_weighted_values": f"{ROWS}, {_VALUES} SELECT sym, ts, {', '.join(f'round(CASE WHEN s8 IS NOT NULL THEN ({_value(a, 4)} + 3 * {_value(a, 8)}) / 4 WHEN s4 IS NOT NULL THEN {_value(a, 4)} END, 6) AS a{i}' for i, a in enumerate(_ACTIONS))} FROM ta",
    "q_advantage_scale": f"{_EDGE} SELECT sym, ts, round(CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0, least(1, edge / greatest(b, 1e-6))) END, 6) AS advantage FROM e JOIN q USING (sym)",
    "q_class_weights": f"{ROWS}, c AS (SELECT sym, CASE WHEN ret < -0.004 THEN 0 WHEN ret > 0.004 THEN 2 ELSE 1 END AS c FROM rows), n AS (SELECT s.sym, k::INT AS class, count(c.c) AS n FROM (SELECT DISTINCT sym FROM c) s CROSS JOIN range(4) r(k) LEFT JOIN c ON c.sym = s.sym AND c.c = k GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY sym) / greatest(n, 1) AS x FROM n) SELECT sym, class, n, round(x / avg(x) OVER (PARTITION BY sym), 6) AS weight FROM w",
    "q_trade_weight": f"{ROWS}, t AS (SELECT sym, abs(pos - lag(pos, 1, 1.0) OVER {W}) > 1e-8 AS t FROM rows), c AS (SELECT sym, count_if(t)::BIGINT AS trades, count_if(NOT t)::BIGINT AS others FROM t GROUP BY sym) SELECT sym, trades, others, round(CASE WHEN trades > 0 AND others > 0 THEN others / trades END, 6) AS weight FROM c",
    "q_chunk_actions": f"{ROWS}, i AS (SELECT *, row_number() OVER {W} - 1 AS i, lag(pos, 1, 1.0) OVER {W} AS b FROM rows), c AS (SELECT *, i // 4 AS chunk, first(b) OVER (PARTITION BY sym, i // 4 ORDER BY i) AS cur FROM i) SELECT sym, chunk::BIGINT AS chunk, min(ts) AS ts, round(min(cur), 6) AS current, round(coalesce(arg_min(pos, i) FILTER (abs(pos - cur) > 1e-8), arg_min(pos, i)), 6) AS action FROM c GROUP BY sym, chunk HAVING count(*) = 4",
    "q_scalars": f"{ROWS} SELECT sym, ts, round(1 / (1 + exp(-100 * ret)), 6) AS sig, round(ln(1 + exp(100 * ret)), 6) AS soft, round(exp(100 * ret) / (exp(100 * ret) + exp(pos) + 1), 6) AS share, ((100 * ret > -0.5)::INT + (100 * ret > 0)::INT + (100 * ret > 0.5)::INT)::INT AS bucket FROM rows",
}
