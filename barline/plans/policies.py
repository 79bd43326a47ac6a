"""Queries on closed-loop rollouts, hidden states, boosted allocators, bundles, gated overlays and the whole feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.frames import clip, ordered, round_to
from barline.operators import align, backtest, boosting, chunks, evaluate, features, folds, labels, regimes, rewards, rollout, teachers
from barline.plans.market import _ATR, _LR, _RSI
from barline.plans.paths import _REC, W, _targets, rows
from barline.plans.teachers import _SIGMOID, chain_sql
from barline.plans.views import BARS_1D, BARS_15M, EXPANDED, FOLDS, PNLS, RETS, ROWS, UNIT, rolling
from barline.sources import bars, bundles

#: The executor of q_rollout.
CONTROL = {"rate_scale": 0.9, "gap_boost": 0.2, "step": 0.3, "grid": 0.01, "snap": 0.015, "active": 0.3, "under": 0.2, "over": 0.15}
#: Rounds, levels and bins of q_hist_allocator.
ALLOCATOR = {"trees": 3, "depth": 2, "bins": 16, "least": 20, "rate": 0.3}
FEATURES = ("lag1", "lag2", "size", "vol")


def q_rollout(spark, sf):
    """Positions of a controller that trades on the size of returns, capped in how often it leaves the benchmark."""
    target = F.when(F.col("ret") < -0.003, -0.4).when(F.col("ret") > 0.003, 0.1).otherwise(0.0)
    df = rows(spark, sf).select("sym", "ts", "ret", (F.abs("ret") * 200).alias("signal"), target.alias("target"), F.lit(0.03).alias("band"))
    return round_to(rollout.rollout(df, **CONTROL).select("sym", "ts", "position", F.col("forced").cast("int").alias("forced")))


def _by_fold(spark, sf):
    rets = bars.returns_1d(spark, sf)
    return folds.expand(rets, folds.bar_splits(rets))


def q_regime_path(spark, sf):
    """States of each fold's test rows by a model from its training quantiles, without rounds of fitting."""
    return regimes.decoded(_by_fold(spark, sf), rounds=0).select("sym", "fold", "ts", "state")


def q_regime_fit(spark, sf):
    """How often each state comes up in the test rows by the fitted model, and what its bars return."""
    df = regimes.decoded(_by_fold(spark, sf), rounds=10)
    return round_to(df.groupBy("sym", "state").agg(F.count(F.lit(1)).alias("bars"), F.avg("ret").alias("ret"), F.avg(F.greatest("p0", "p1", "p2")).alias("sure")), 4)


def q_teacher_bundles(spark, sf):
    """Training and validation positions of each fold through packed bundles and back."""
    df = _by_fold(spark, sf).where("role <> 'test'").withColumn("pos", F.when(F.col("ret") > 0, 1.12).otherwise(0.5))
    made = bundles.packed(df, {"train_positions": "pos:role = 'train'", "val_positions": "pos:role = 'val'"}, ("sym", "fold"))
    out = bundles.unpacked(made, keep=("sym", "fold"))
    return out.select("sym", "fold", "name", F.col("shape")[0].alias("length"), "i", F.col("value").alias("position"))


def _allocator_rows(spark, sf):
    x = rows(spark, sf)
    late = lambda n: F.lag("ret", n).over(ordered())
    x = x.withColumns({"lag1": late(1), "lag2": late(2), "size": F.abs(late(1)), "vol": F.stddev_pop("ret").over(ordered().rowsBetween(-10, -1)), "target": F.when(F.col("ret") > 0, 1.12).otherwise(0.5)})
    return folds.expand(x, folds.bar_splits(bars.returns_1d(spark, sf)))


def q_hist_allocator(spark, sf):
    """Test positions of boosted trees that learn a teacher's positions from past returns, a model for each symbol and fold."""
    df = boosting.boosted(_allocator_rows(spark, sf), FEATURES, "target", "role = 'train'", **ALLOCATOR)
    return round_to(df.where("role = 'test'").select("sym", "fold", "ts", clip(F.col("predicted"), 0.5, 1.12).alias("position")))


def q_risk_gated_chain(spark, sf):
    """The overlay chain with other scales below and above the benchmark and a risk gate from a vector's elements."""
    vector = F.array(F.col("ret") * 100, F.abs("ret") * 100, F.lit(0.2))
    df = _targets(spark, sf).withColumn("gate", teachers.risk_gate(teachers.vector_signal(vector, (1, 2, 7)), 0.3, 4.0, 0.25))
    return round_to(chunks.overlay_chain(df, risk="gate", down_scale=0.8, up_scale=0.5).select("sym", "ts", "position"))


def q_vector_states(spark, sf):
    """Signal, risk state and gate of chosen elements of the embeddings."""
    df = bars.read(spark, sf, "embeddings")
    return round_to(df.select("vec_id", teachers.vector_signal(F.col("embedding"), (0, 3, 5, 99)).alias("signal"), teachers.risk_state(F.col("embedding"), (1, 2), 0.01, 3.0).alias("risk"), teachers.risk_gate(teachers.vector_signal(F.col("embedding"), (4,)), 0.0, 5.0, 0.1).alias("gate")), 5)


def q_path_windows(spark, sf):
    """Windows of 5 bars: their returns' sum, their last position and the position at their start."""
    df = labels.path_windows(rows(spark, sf), ("ret", "pos"), 5)
    return round_to(df.select("sym", "ts", "start", F.aggregate("ret_path", F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at("pos_path", -1).alias("last"), F.size("pos_path").alias("n")))


def q_context_means(spark, sf):
    """Context of past rows, with the trailing means of the logarithms of volume and range."""
    df = bars.bars_15m(spark, sf).withColumns({"r": features.raw_return(), "size": F.ln("volume"), "range": F.ln(F.col("high") - F.col("low") + 1)})
    out = features.add_context(df, (24,), means={"size": "flow", "range": "range"})
    return round_to(out.select("sym", "ts", "ctx_flow_24", "ctx_range_24", "ctx_mom_24"), 5)


#: Windows of the whole feature table.
RV, Z, SIDE = (2, 4), 60, 12


def q_composite(spark, sf):
    """The whole feature table: prices, RSI, MACD pair, ATR forms, volatility, funding, open interest, basis and a further series, z-scored."""
    df = chunks.macd(bars.bars_1d(spark, sf))
    mark, funding = bars.mark_1d(spark, sf), bars.read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg((F.avg("l_discount") / 100).alias("funding_rate"))
    df = align.asof(align.asof(df, mark, "mark_close", fill_head=True), funding, "funding_rate", zero=True)
    interest = bars.read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("open_interest"))
    flow = bars.read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.avg("l_tax").alias("flow"))
    df = align.asof(align.asof(df, interest, "open_interest", fill_head=True), flow, "flow", fill_head=True)
    return round_to(features.composite(df, Z, RV, side=("flow",), windows=(SIDE,)), 3)


def q_local_drawdown(spark, sf):
    """Drawdowns of each symbol's pnl, as positive depths."""
    return round_to(backtest.local_drawdown(backtest.with_pnl(rows(spark, sf))).select("sym", "ts", "local_dd"))


def q_sequence_net(spark, sf):
    """Net returns of positions in sequences of 16 bars, each from flat, beyond the benchmark's."""
    n = F.row_number().over(ordered()) - 1
    steps = rows(spark, sf).withColumns({"episode": F.floor(n / 16), "step": n % 16})
    return round_to(rewards.net_returns(steps, ("sym", "episode"), bench=1.0).select("sym", "ts", "episode", "step", "net"), 8)


def q_selected_folds(spark, sf):
    """Rows of the folds that a text names, by role."""
    rets = bars.returns_1d(spark, sf)
    chosen = folds.select(folds.bar_splits(rets), "0-1,3,1")
    return folds.expand(rets, chosen).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def q_first_seen(spark, sf):
    """Each user's kinds of event, in the order in which they first came up, and sorted."""
    df = bars.read(spark, sf, "events")
    first = evaluate.distinct_values(df, "event_type", ("user_id",))
    return first.join(evaluate.distinct_values(df, "event_type", ("user_id",), sort=True).withColumnRenamed("values", "kinds"), "user_id").select("user_id", F.array_join("values", ",").alias("seen"), F.array_join("kinds", ",").alias("kinds"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_K = CONTROL
_ROLL = f"""{_REC}, t AS MATERIALIZED (SELECT sym, ts, least(1, greatest(0, abs(ret) * 200 * {_K['rate_scale']})) AS rate, CASE WHEN ret < -0.003 THEN -0.4 WHEN ret > 0.003 THEN 0.1 ELSE 0.0 END::DOUBLE AS target, row_number() OVER {W} AS n FROM rows),
h AS (
  SELECT DISTINCT sym, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 0.0::DOUBLE AS o, 1.0::DOUBLE AS position, 0 AS forced, 0 AS active, 0 AS under, 0 AS long FROM t
  UNION ALL
  SELECT sym, ts, n, CASE WHEN f THEN 0.0 ELSE o END, CASE WHEN f THEN 1.0 ELSE p END, f::INT, active + (NOT f AND abs(o) > 0.05)::INT, under + (NOT f AND o < -0.05)::INT, long + (NOT f AND o > 0.05)::INT
  FROM (SELECT *, abs(o) > 0.05 AND active + 1 > ceil({_K['active']} * n) OR o < -0.05 AND under + 1 > ceil({_K['under']} * n) OR o > 0.05 AND long + 1 > ceil({_K['over']} * n) AS f
    FROM (SELECT * REPLACE (CASE WHEN abs(p - 1.0) <= {_K['snap']} THEN 1.0 ELSE p END AS p), CASE WHEN abs(p - 1.0) <= {_K['snap']} THEN 0.0 ELSE p - 1.0 END AS o
      FROM (SELECT sym, ts, n, active, under, long, round_even((1.0 + least(0.12, greatest(-0.5, was + least(1, rate + {_K['gap_boost']} * tanh(greatest(abs(gap) - 0.03, 0) / 0.03)) / (1 + exp(-16.0 * (abs(gap) - 0.03))) * least(0.3, greatest(-0.3, gap))))) / 0.01, 0) * 0.01 AS p
        FROM (SELECT t.sym, t.ts, t.n, rate, h.o AS was, target - h.o AS gap, active, under, long FROM h JOIN t ON t.sym = h.sym AND t.n = h.n + 1)))))"""
_LN = {(a, b): f"ln({0.9 if a == b else 0.05})" for a in range(3) for b in range(3)}
_TO = [[f"v[{a + 1}] + {_LN[a, b]}" for a in range(3)] for b in range(3)]
_FIRST = lambda xs: f"CASE WHEN {xs[0]} >= greatest({xs[1]}, {xs[2]}) THEN 0 WHEN {xs[1]} >= {xs[2]} THEN 1 ELSE 2 END"
_PATHS = f"""{RETS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {FOLDS}, {EXPANDED},
m AS (SELECT sym, fold, [quantile_cont(ret, 1 / 6), quantile_cont(ret, 0.5), quantile_cont(ret, 5 / 6)] AS mean, greatest(stddev_pop(ret), 1e-6) AS s FROM fr WHERE role = 'train' GROUP BY ALL HAVING count(*) > 1),
x AS MATERIALIZED (SELECT sym, fold, ts, row_number() OVER (PARTITION BY sym, fold ORDER BY ts) AS n, count(*) OVER (PARTITION BY sym, fold) AS size, list_transform(mean, lambda a: -0.5 * ((ret - a) / s) ** 2 - ln(s)) AS l FROM fr JOIN m USING (sym, fold) WHERE role = 'test'),
f AS (
  SELECT sym, fold, n, list_transform(l, lambda a: ln(1 / 3) + a) AS v, [0, 0, 0] AS b FROM x WHERE n = 1
  UNION ALL
  SELECT x.sym, x.fold, x.n, [{', '.join(f'greatest({", ".join(to)}) + l[{i + 1}]' for i, to in enumerate(_TO))}], [{', '.join(_FIRST(to) for to in _TO)}] FROM f JOIN x ON x.sym = f.sym AND x.fold = f.fold AND x.n = f.n + 1),
fm AS MATERIALIZED (SELECT * FROM f),
p AS (
  SELECT sym, fold, n, {_FIRST(['v[1]', 'v[2]', 'v[3]'])} AS state FROM fm JOIN x USING (sym, fold, n) WHERE n = size
  UNION ALL
  SELECT p.sym, p.fold, p.n - 1, fm.b[p.state + 1] FROM p JOIN fm ON fm.sym = p.sym AND fm.fold = p.fold AND fm.n = p.n WHERE p.n > 1)"""
_RISK = f"(0.25 + 0.75 * {_SIGMOID.format(x='((abs(ret) * 100 + 0.2) / 2 - 0.3) * 4')})"
_C15 = f"WITH {BARS_15M}, c0 AS (SELECT *, ln(close / lag(close) OVER {W}) AS r, ln(high - low + 1) AS x, ln(volume) AS y FROM bars15), c1 AS (SELECT *, sum(r) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM c0), c2 AS (SELECT sym, ts, {rolling('avg(y) OVER @', 24, 8, 'y')} AS f, {rolling('avg(x) OVER @', 24, 8)} AS g, c - lag(c, 24) OVER {W} AS m FROM c1)"
_SERIES = {"mark_close": ("avg(l_extendedprice)", True), "funding_rate": ("avg(l_discount) / 100", False), "open_interest": ("sum(l_quantity)", True), "flow": ("avg(l_tax)", True)}
_ALL = ["open_ret", "high_ret", "low_ret", "close_ret", "volume_ret", "rsi", "macd", "macd_signal", "atr_norm_ret", "atr", "rv_2", "rv_4", "funding_rate", "oi_change", "basis", "basis_mom", "basis_abs", "flow", "flow_delta1", "flow_abs", "flow_mean_12", "flow_std_12", "flow_z_12", "flow_impulse_12"]
_SIDES = ", ".join(f"side_{c} AS (SELECT l_shipdate AS ts, {x} AS {c} FROM lineitem GROUP BY 1)" for c, (x, _) in _SERIES.items())
_JOINED = "bars b " + " ".join(f"ASOF LEFT JOIN side_{c} ON b.ts >= side_{c}.ts" for c in _SERIES)
_VALUE = ", ".join(f"coalesce(side_{c}.{c}, {f'(SELECT arg_min({c}, ts) FROM side_{c})' if head else '0'}) AS {c}" for c, (_, head) in _SERIES.items())
_COMPOSITE = f"""WITH RECURSIVE {BARS_1D}, {_ATR}, {_RSI}, nb AS MATERIALIZED (SELECT sym, ts, close, row_number() OVER {W} AS n FROM bars),
e AS (
  SELECT sym, ts, n, close AS f, close AS s, 0.0::DOUBLE AS g FROM nb WHERE n = 1
  UNION ALL
  SELECT nb.sym, nb.ts, nb.n, e.f + (nb.close - e.f) * 2 / 13, e.s + (nb.close - e.s) * 2 / 27, e.g + ((e.f + (nb.close - e.f) * 2 / 13) - (e.s + (nb.close - e.s) * 2 / 27) - e.g) * 2 / 10
  FROM e JOIN nb ON nb.sym = e.sym AND nb.n = e.n + 1),
md AS (SELECT sym, ts, lag(f - s) OVER {W} AS macd, lag(g) OVER {W} AS macd_signal FROM e), {_SIDES}, sd AS (SELECT b.sym, b.ts, b.close, {_VALUE} FROM {_JOINED}),
s0 AS (SELECT sym, ts, lag(funding_rate) OVER {W} AS funding_rate, coalesce(ln(open_interest / lag(open_interest) OVER {W}), 0) AS oi, lag(ln(mark_close / close)) OVER {W} AS basis, lag(flow) OVER {W} AS flow FROM sd),
s1 AS (SELECT *, lag(oi) OVER {W} AS oi_change, basis - lag(basis) OVER {W} AS bm, flow - lag(flow) OVER {W} AS flow_delta1, abs(flow) AS flow_abs, {rolling('avg(flow) OVER @', SIDE, 4, 'flow')} AS flow_mean_12, {rolling('stddev_samp(flow) OVER @', SIDE, 4, 'flow')} AS flow_std_12,
  {rolling('(flow - avg(flow) OVER @) / (stddev_samp(flow) OVER @ + 1e-8)', SIDE, 4, 'flow')} AS flow_z_12, {rolling('abs(flow - avg(flow) OVER @)', SIDE, 4, 'flow')} AS flow_impulse_12 FROM s0),
s2 AS (SELECT *, lag(bm) OVER {W} AS basis_mom, lag(abs(basis)) OVER {W} AS basis_abs FROM s1),
rr AS (SELECT *, ln(close / lag(close) OVER {W}) AS r FROM atr), v AS (SELECT rr.*, {rolling('stddev_samp(r) OVER @', 2, 1, 'r')} AS v2, {rolling('stddev_samp(r) OVER @', 4, 2, 'r')} AS v4 FROM rr),
f0 AS (SELECT sym, ts, atr, {_LR}, lag(close) OVER {W} AS pc, lag(v2) OVER {W} AS rv_2, lag(v4) OVER {W} AS rv_4 FROM v),
f AS (SELECT f0.*, rsi, macd, macd_signal, close_ret / (atr / pc + 1e-8) AS atr_norm_ret, s2.* EXCLUDE (sym, ts) FROM f0 JOIN rsi USING (sym, ts) JOIN md USING (sym, ts) JOIN s2 USING (sym, ts)),
z AS (SELECT sym, ts, {', '.join(rolling(f'({c} - avg({c}) OVER @) / (stddev_samp({c}) OVER @ + 1e-8)', Z, Z // 4, c) + f' AS {c}_zz' for c in _ALL)} FROM f)
SELECT sym, ts, {', '.join(f'round({c}_zz, 3) AS {c}' for c in _ALL)} FROM z WHERE {' AND '.join(f'{c}_zz IS NOT NULL' for c in _ALL)}"""

ORACLES = {
    "q_rollout": f"{_ROLL} SELECT sym, ts, round(position, 6) AS position, forced FROM h WHERE n > 0",
    "q_regime_path": f"{_PATHS} SELECT sym, fold, ts, state::INT AS state FROM p JOIN x USING (sym, fold, n)",
    "q_teacher_bundles": f"{RETS}, {FOLDS}, {EXPANDED} SELECT sym, fold, role || '_positions' AS name, count(*) OVER w AS length, row_number() OVER (w ORDER BY ts) - 1 AS i, CASE WHEN ret > 0 THEN 1.12 ELSE 0.5 END::DOUBLE AS position FROM fr WHERE role <> 'test' WINDOW w AS (PARTITION BY sym, fold, role)",
    "q_risk_gated_chain": f"{_REC}, {chain_sql(f'CASE WHEN target < 1 THEN (target - 1) * 0.8 * {_RISK} ELSE (target - 1) * 0.5 END')} SELECT sym, ts, round(position, 6) AS position FROM chain",
    "q_vector_states": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round((v[1] + v[4] + v[6]) / 3, 5) AS signal, round(greatest(((v[2] + v[3]) / 2 - 0.01) * 3, 0), 5) AS risk, round(0.1 + 0.9 * {_SIGMOID.format(x='v[5] * 5')}, 5) AS gate FROM e",
    "q_path_windows": f"{ROWS} SELECT sym, ts, pos AS start, round(ret + lead(ret, 1) OVER {W} + lead(ret, 2) OVER {W} + lead(ret, 3) OVER {W} + lead(ret, 4) OVER {W}, 6) AS total, lead(pos, 4) OVER {W} AS last, 5 AS n FROM rows QUALIFY lead(pos, 4) OVER {W} IS NOT NULL",
    "q_context_means": f"{_C15} SELECT sym, ts, round(lag(f) OVER {W}, 5) AS ctx_flow_24, round(lag(g) OVER {W}, 5) AS ctx_range_24, round(lag(m) OVER {W}, 5) AS ctx_mom_24 FROM c2",
    "q_composite": _COMPOSITE,
    "q_local_drawdown": f"{PNLS}, e AS (SELECT sym, ts, exp(sum(pnl) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS e FROM pnl) SELECT sym, ts, round(greatest(1 - e / max(e) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING), 0), 6) AS local_dd FROM e",
    "q_sequence_net": f"{ROWS}, s AS (SELECT *, row_number() OVER {W} - 1 AS n FROM rows) SELECT sym, ts, n // 16 AS episode, (n % 16)::INT AS step, round((pos - 1) * ret - {UNIT} * abs(pos - CASE WHEN n % 16 = 0 THEN 0 ELSE lag(pos) OVER {W} END), 8) AS net FROM s",
    "q_selected_folds": f"{RETS}, {FOLDS}, {EXPANDED} SELECT fold, role, count(*) AS n FROM fr WHERE fold IN (0, 1, 3) GROUP BY ALL",
    "q_first_seen": "WITH f AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY t, event_type) AS seen, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM f GROUP BY user_id",
}
