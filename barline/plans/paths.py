"""Queries on labels, position paths, backtests, selection and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.frames import ordered, round_to
from barline.operators import backtest, chunks, diagnostics, folds, labels, overfit, rewards, scans, selection
from barline.operators.quantiles import quantiles
from barline.plans.views import EQS, FOLDS, PNLS, ROWS, SPECS, UNIT
from barline.sources import bars

W = "(PARTITION BY sym ORDER BY ts)"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily returns with a position that leans long after a gain."""
    pos = F.when(F.lag("ret").over(ordered()) > 0, 1.12).otherwise(0.5)
    return bars.returns_1d(spark, sf).withColumn("pos", pos)


def q_backtest_summary(spark, sf):
    return round_to(backtest.summary(rows(spark, sf)))


def q_backtest_full(spark, sf):
    return round_to(backtest.full(rows(spark, sf)))


def q_equity_curve(spark, sf):
    df = backtest.with_equity(backtest.with_pnl(rows(spark, sf)))
    return round_to(df.select("sym", "ts", "pnl", "equity", "bench_equity", "dd"))


def q_pnl_attribution(spark, sf):
    return round_to(backtest.attribution(rows(spark, sf)))


def q_regime_backtest(spark, sf):
    df = rows(spark, sf).withColumn("regime", F.when(F.abs("ret") > 0.005, "wild").otherwise("calm"))
    return round_to(backtest.by_regime(df, "regime").select("sym", "regime", "bars", "sharpe", "total_return", "max_dd", "fraction"))


def q_period_win_rate(spark, sf):
    return round_to(backtest.period_win_rate(rows(spark, sf), 21))


def q_underperf_streak(spark, sf):
    return backtest.underperformance(rows(spark, sf))


def q_holding_runs(spark, sf):
    return round_to(backtest.holding_runs(rows(spark, sf)))


def q_recovery_latency(spark, sf):
    return round_to(backtest.recovery_latency(rows(spark, sf)))


def q_action_stats(spark, sf):
    return round_to(backtest.action_stats(rows(spark, sf)))


def q_maxdd_interval(spark, sf):
    return round_to(diagnostics.maxdd_interval(rows(spark, sf)))


def q_fire_runs(spark, sf):
    return diagnostics.fire_runs(rows(spark, sf).withColumn("fire", F.col("pos") > 1), "fire")


def q_trade_markers(spark, sf):
    return round_to(diagnostics.trade_markers(rows(spark, sf)))


def q_active_blocks(spark, sf):
    df = rows(spark, sf).withColumn("pos", F.when(F.abs("ret") > 0.004, F.col("pos")).otherwise(1.0))
    return diagnostics.active_blocks(df)


def q_fire_metrics(spark, sf):
    df = rows(spark, sf).withColumn("base", F.when(F.abs("ret") > 0.004, F.lit(1.0)).otherwise(F.col("pos")))
    return round_to(diagnostics.fire_metrics(df))


def q_sequence_windows(spark, sf):
    df = diagnostics.sequence_windows(rows(spark, sf), 16, "ret")
    return round_to(df.select("sym", "ts", F.size("window").alias("n"), F.aggregate("window", F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at("window", -1).alias("last")))


def q_controller_state(spark, sf):
    return round_to(diagnostics.controller_state(rows(spark, sf), cooldown=16).select("sym", "ts", "over", "delta", "hold_age", "under_age", "cooldown"))


def q_forward_stats(spark, sf):
    total, dev = labels.forward_stats(8)
    return round_to(rows(spark, sf).select("sym", "ts", total.alias("fwd_sum"), dev.alias("fwd_std"), labels.forward_sum(8).alias("whole_sum"), labels.forward_vol(8).alias("whole_vol")))


def q_forward_dd(spark, sf):
    return round_to(rows(spark, sf).select("sym", "ts", labels.forward_drawdown(4).alias("fwd_dd")))


def q_signal_teacher(spark, sf):
    return round_to(labels.signal_teacher(rows(spark, sf)).select("sym", "ts", "signal", "target"), 5)


def q_outcome_edge(spark, sf):
    return round_to(labels.outcome_edge(rows(spark, sf), "pos").select("sym", "ts", "edge"))


def q_stress_teacher(spark, sf):
    df = rows(spark, sf).withColumns({"a": F.col("ret") * 100, "b": F.abs("ret") * 100})
    return round_to(labels.stress_target(df, {"a": (1.0, 0.2, -1.0), "b": (0.5, 0.3, 1.0), "missing": (1.0, 0.5, 1.0)}).select("sym", "ts", "stress", "target"))


def q_regime_probs(spark, sf):
    p = labels.triangular(F.abs("ret") * 100)
    return round_to(rows(spark, sf).select("sym", "ts", p.alias("p")).select("sym", "ts", *(F.col("p")[i].alias(f"p{i}") for i in range(3))))


def _advantage(spark, sf):
    return labels.transition_advantage(rows(spark, sf))


def q_transition_advantage(spark, sf):
    return round_to(_advantage(spark, sf).select("sym", "ts", "best_target", "best_value", "best_advantage", "best_class"))


def q_transition_matrix(spark, sf):
    bucket = lambda c: F.when(F.col(c) < 1 - 1e-6, "under").when(F.col(c) > 1 + 1e-6, "over").otherwise("flat")
    df = _advantage(spark, sf).select(bucket("pos").alias("now"), bucket("best_target").alias("then"))
    counts = df.groupBy("now", "then").agg(F.count(F.lit(1)).alias("n"))
    return round_to(counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("now"))))


def q_transition_summary(spark, sf):
    df = labels.transition_values(rows(spark, sf)).select(F.posexplode("values").alias("action", "v")).where("v is not null")
    q = quantiles(df, "v", (0.1, 0.5, 0.9), ("action",), "q")
    out = df.join(F.broadcast(q), "action").groupBy("action", F.col("q")[1].alias("median")).agg(  # one row for each action
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.avg(F.when(F.col("v") >= F.col("q")[2], F.col("v"))).alias("top_mean"),
        F.avg(F.when(F.col("v") <= F.col("q")[0], F.col("v"))).alias("bottom_mean"), F.avg((F.col("v") > 0).cast("double")).alias("positive_rate"),
    )
    return round_to(out)


def q_route_summary(spark, sf):
    df = _advantage(spark, sf).groupBy(labels.route(F.col("best_class")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.avg("best_advantage").alias("advantage"))
    all_ = spark.range(4).select(F.col("id").cast("int").alias("route"))
    return round_to(all_.join(df, "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("advantage", F.lit(0.0)).alias("advantage")))


def q_future_return_targets(spark, sf):
    return round_to(rows(spark, sf).select("sym", "ts", labels.future_returns(4, 0).alias("r4_0"), labels.future_returns(8, 1).alias("r8_1")))


def q_future_risk_targets(spark, sf):
    return round_to(labels.future_risk(rows(spark, sf), 4, 0.01, 0.005).select("sym", "ts", "vol_4", "depth_4", "crash_4", "excess_4"))


def q_position_utility(spark, sf):
    return round_to(labels.position_utility(rows(spark, sf), 4))


def q_oracle_dp(spark, sf):
    df = chunks.hindsight(rows(spark, sf).select("sym", "ts", "ret"), bench=1.0)
    return round_to(df.select("sym", "ts", "best", "value"))


def _targets(spark, sf):
    """Targets that fall with the last return's size."""
    return rows(spark, sf).withColumn("target", F.when(F.col("ret") < -0.003, 0.4).when(F.col("ret") > 0.003, 1.2).otherwise(1.0))


def q_min_hold(spark, sf):
    return chunks.min_hold(_targets(spark, sf), 5).select("sym", "ts", "held")


def q_smooth_aim(spark, sf):
    df = labels.add_underweight_run(_targets(spark, sf))
    out = chunks.smooth_aim(df, 0.1, 0.02, 1.0, 0.3, 1.12, confirm=3, step_scale=0.5, floor=0.45)
    return round_to(out.select("sym", "ts", "future_run", "aim"))


def q_execute_targets(spark, sf):
    return round_to(chunks.execute(_targets(spark, sf), 0.8, 3).select("sym", "ts", "position"))


def q_overlay_chain(spark, sf):
    return round_to(chunks.overlay_chain(_targets(spark, sf)).select("sym", "ts", "position"))


def _grid(spark, sf):
    """Validation and test metrics of executed vol targets for each fold, symbol and setting."""
    rets = bars.returns_1d(spark, sf)
    rms = F.sqrt(F.avg(F.pow(F.coalesce(F.lag("ret").over(ordered()), F.lit(0.0)), F.lit(2))).over(ordered().rowsBetween(-19, 0)))
    with_vol = rets.withColumn("vol", rms)
    fr = folds.expand(with_vol, folds.bar_splits(rets))
    level = fr.where("role = 'train'").groupBy("sym", "fold").agg(F.percentile("vol", F.lit(0.5)).alias("level"))
    goal = F.greatest(F.lit(0.5), F.least(F.lit(1.12), F.col("level") / F.greatest(F.col("vol"), F.lit(1e-8))))
    test = fr.where("role = 'test'").join(level, ["sym", "fold"]).withColumn("target", goal)
    paths = [f"p{i}" for i in range(len(SPECS))]
    wide = scans.scan(test.select("sym", "fold", "ts", "ret", "target"), lambda t: scans.execute_grid(t, SPECS), ("target",), tuple(paths), by=("sym", "fold"))
    return wide.select("sym", "fold", "ts", "ret", F.posexplode(F.array(*paths)).alias("spec", "pos")), ("sym", "fold", "spec")


def q_vol_target_grid(spark, sf):
    df, by = _grid(spark, sf)
    return round_to(backtest.summary(df, by).select(*by, "bars", "total_return", "max_dd", "final_excess", "maxdd_delta"), 5)


def _metrics(spark, sf):
    """Candidates for selection: the grid's figures, and holding the benchmark."""
    df, by = _grid(spark, sf)
    turn = df.withColumn("d", F.abs(F.col("pos") - F.lag("pos").over(ordered(by)))).groupBy(*by).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("turnover"))
    m = backtest.summary(df, by).join(turn, list(by))
    m = m.select(*by, (100 * F.col("final_excess")).alias("alpha_pt"), (100 * F.col("maxdd_delta")).alias("maxdd_pt"), "sharpe_delta", "turnover")
    return round_to(m, 5)


def q_policy_family_summary(spark, sf):
    return round_to(selection.family_summary(_metrics(spark, sf), "spec"), 4)


def q_scorecard(spark, sf):
    stats = backtest.action_stats(rows(spark, sf))
    m = backtest.summary(rows(spark, sf)).join(stats, "sym").join(backtest.period_win_rate(rows(spark, sf), 21), "sym")
    m = m.withColumns({"alpha_pt": 100 * F.col("final_excess"), "maxdd_pt": 100 * F.col("maxdd_delta")})
    return round_to(selection.scorecard(m).select("sym", "alpha_pt", "maxdd_pt", "sharpe_delta", "win_rate", "ok_alpha", "ok_sharpe", "ok_maxdd", "ok_win_rate", "ok_collapse", "stretch_hit", "m2_pass"))


def _fold_scores(spark, sf):
    rets = rows(spark, sf)
    fr = folds.expand(rets, folds.bar_splits(rets)).where("role = 'test'")
    s = backtest.with_pnl(fr, by=("sym", "fold")).groupBy("fold").agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"))
    return s.select("fold", F.when(F.col("s") < 1e-10, 0.0).otherwise(F.try_divide("m", "s")).alias("score"))


def q_pbo(spark, sf):
    return round_to(overfit.pbo(_fold_scores(spark, sf)))


def q_deflated_sharpe(spark, sf):
    df = backtest.with_pnl(rows(spark, sf))
    skew, kurt = overfit.moments("pnl")
    m = df.groupBy("sym").agg(backtest.sharpe("pnl").alias("sr"), F.count(F.lit(1)).alias("n"), skew.alias("skew"), kurt.alias("kurt"))
    return round_to(m.withColumn("z", overfit.deflated_sharpe(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), 10)), 4)


def q_support_counts(spark, sf):
    now = labels.nearest(F.col("pos"))
    df = rows(spark, sf).withColumn("regime", F.when(F.abs("ret") > 0.005, 1).otherwise(0)).withColumn("now", now).withColumn("next", F.lead("now").over(ordered()))
    return df.where("next is not null").groupBy("regime", "now", "next").agg(F.count(F.lit(1)).alias("n"))


def q_regime_prior(spark, sf):
    df = rows(spark, sf).select((F.col("ret") > 0.002).cast("int").alias("label"), labels.triangular(F.abs("ret") * 100).alias("regime"))
    return round_to(diagnostics.regime_prior(df))


def _episodes(spark, sf):
    """Events of each user in groups of eight."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = bars.read(spark, sf, "events").select("user_id", "ts", "event_id", "value").withColumn("n", F.row_number().over(w) - 1)
    df = df.withColumns({"chunk": F.floor(F.col("n") / 8), "step": F.col("n") % 8})
    return df


def q_lambda_return(spark, sf):
    packed = _episodes(spark, sf).groupBy("user_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("a")).where("size(a) = 8")
    reward = F.transform("a", lambda x: x["value"] / 100 - 0.5)
    value = F.transform("a", lambda x: x["value"] / 200)
    out = packed.select("user_id", "chunk", rewards.lambda_returns(reward, value, F.element_at(value, 8)).alias("g"))
    return round_to(out.select("user_id", "chunk", F.col("g")[0].alias("g0"), F.col("g")[7].alias("g7")))


def q_rollout_rewards(spark, sf):
    df = _episodes(spark, sf).select("user_id", "chunk", "step", (F.col("value") / 1e4 - 0.005).alias("ret"), F.when(F.col("step") % 3 == 0, 1.1).otherwise(0.8).alias("pos"))
    return round_to(rewards.rollout_rewards(df, ("user_id", "chunk")).groupBy("user_id", "chunk").agg(F.sum("reward").alias("reward"), F.max("level").alias("level")), 9)


def q_twohot(spark, sf):
    t = rewards.two_hot(rewards.symlog(F.col("ret") * 100), -3.0, 3.0, 31)
    return round_to(rows(spark, sf).select("sym", "ts", t["bin"].alias("bin"), t["upper"].alias("upper")))


def q_soft_label(spark, sf):
    s = rewards.soft_label(F.col("ret") * 100, (-1.0, -0.25, 0.0, 0.5, 1.0))
    return round_to(rows(spark, sf).select("sym", "ts", s.alias("s")).select("sym", "ts", *(F.col("s")[i].alias(f"s{i}") for i in range(5))))


def q_knn_anchor(spark, sf, bank_size=32):
    """The nearest of ``bank_size`` anchors that are evenly spaced over all rows."""
    v = bars.read(spark, sf, "embeddings")
    return round_to(rewards.nearest_anchor(v, rewards.anchor_bank(v, bank_size)), 5)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}


def _round(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _sharpe(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) < 1e-10 THEN 0 ELSE avg({x}) / stddev_pop({x}) * sqrt(252) END"


def _fwd(h: int, agg: str, first: int = 0) -> str:
    return f"{agg} OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN {'CURRENT ROW' if first == 0 else f'{first} FOLLOWING'} AND {first + h - 1} FOLLOWING)"


def _whole(h: int, expr: str, first: int = 0) -> str:
    return f"CASE WHEN {_fwd(h, 'count(ret)', first)} = {h} THEN {expr} END"


_DD = "list_reduce({path}, lambda s, x: struct_pack(c := s.c + {k} * x.c, p := greatest(s.p, s.c + {k} * x.c), d := greatest(s.d, greatest(s.p, s.c + {k} * x.c) - (s.c + {k} * x.c))), struct_pack(c := 0.0::DOUBLE, p := 0.0::DOUBLE, d := 0.0::DOUBLE)).d"


def _dd(path: str, k: str = "1") -> str:
    return _DD.format(path=f"list_transform({path}, lambda z: struct_pack(c := z, p := 0.0::DOUBLE, d := 0.0::DOUBLE))", k=k)


_SUMMARY = f"""s AS (SELECT sym, count(*) AS bars, {_sharpe('pnl')} AS sharpe, {_sharpe('bench_pnl')} AS bench_sharpe, exp(sum(pnl)) - 1 AS total_return, exp(sum(bench_pnl)) - 1 AS bench_return,
 min(dd) AS max_dd, min(bench_dd) AS bench_dd, sum(cost) AS cost FROM eq GROUP BY sym)"""
_RUNS = "SELECT *, sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM {t}"
_STATS = f"""st0 AS (SELECT *, pos - 1 AS o, abs(pos - lag(pos) OVER {W}) AS step FROM rows), ref AS (SELECT sym, greatest(coalesce(quantile_cont(CASE WHEN step > 1e-8 THEN step END, 0.9), 0), 0.05) AS step_ref FROM st0 GROUP BY sym),
st AS (SELECT sym, step_ref, avg((o > 0.05)::DOUBLE) AS long_share, avg((o < -0.05)::DOUBLE) AS short_share, avg((abs(o) <= 0.05)::DOUBLE) AS flat_share, avg(o) AS mean_overlay, coalesce(sum(step), 0) AS turnover,
 coalesce(sum(round_even(step / step_ref, 0)), 0) AS switches, count(*) / greatest(coalesce(sum(round_even(step / step_ref, 0)), 0), 1) AS avg_hold FROM st0 JOIN ref USING (sym) GROUP BY ALL)"""
_WIN = f"pw0 AS (SELECT sym, (row_number() OVER {W} - 1) // 21 AS b, pnl, bench_pnl FROM pnl), pw AS (SELECT sym, count(*) AS periods, avg((a > 0)::DOUBLE) AS win_rate FROM (SELECT sym, b, sum(pnl) - sum(bench_pnl) AS a FROM pw0 GROUP BY ALL) GROUP BY sym)"
_TARGETS = "tg AS (SELECT *, CASE WHEN ret < -0.003 THEN 0.4 WHEN ret > 0.003 THEN 1.2 ELSE 1.0 END::DOUBLE AS target, row_number() OVER (PARTITION BY sym ORDER BY ts) AS n FROM rows)"
_REC = ROWS.replace("WITH ", "WITH RECURSIVE ", 1)
_ACTIONS = (0.0, 0.5, 1.0, 1.25)


def _value(a: float, h: int) -> str:
    o = a - 1
    return f"({o} * s{h} - {UNIT} * abs({a} - pos) - 0.1 * v{h} * {abs(o)} - 0.2 * {abs(o)} * {'u' if o > 0 else 'd'}{h})"


_VALUES = (
    "ta0 AS (SELECT *, " + ", ".join(f"{_whole(h, _fwd(h, 'sum(ret)'))} AS s{h}, {_whole(h, _fwd(h, 'stddev_pop(ret)') + f' * sqrt({h})')} AS v{h}, {_whole(h, _fwd(h, 'list(ret)'))} AS p{h}" for h in (4, 8)) + " FROM rows), "
    "ta1 AS (SELECT *, " + ", ".join(f"{_dd(f'p{h}')} AS u{h}, {_dd(f'p{h}', '-1')} AS d{h}" for h in (4, 8)) + " FROM ta0), "
    "ta AS (SELECT *, " + ", ".join(f"CASE WHEN s8 IS NOT NULL THEN ({_value(a, 4)} + {_value(a, 8)}) / 2 WHEN s4 IS NOT NULL THEN {_value(a, 4)} END AS a{i}" for i, a in enumerate(_ACTIONS)) + " FROM ta1)"
)
_BEST = """tb AS (SELECT *, CASE WHEN a0 IS NULL THEN NULL WHEN a0 >= greatest(a1, a2, a3) THEN 0 WHEN a1 >= greatest(a2, a3) THEN 1 WHEN a2 >= a3 THEN 2 ELSE 3 END AS bi, greatest(a0, a1, a2, a3) AS bv, CASE WHEN pos = 0.5 THEN a1 ELSE a2 END AS nowv FROM ta),
tc AS (SELECT *, greatest(bv - a2, bv - nowv, 0) AS gain FROM tb),
td AS (SELECT *, CASE WHEN bv IS NULL OR gain <= 0 THEN 1.0 ELSE [0.0, 0.5, 1.0, 1.25][bi + 1] END::DOUBLE AS best_target, CASE WHEN bv IS NULL OR gain <= 0 THEN a2 ELSE bv END AS best_value, CASE WHEN bv IS NULL OR gain <= 0 THEN 0 ELSE gain END AS best_advantage FROM tc),
te AS (SELECT *, CASE WHEN best_target > 1 + 1e-6 THEN 'overweight' WHEN best_target < 1 - 1e-6 THEN CASE WHEN pos < 1 - 1e-6 THEN 'stay_underweight' ELSE 'de_risk' END WHEN pos < 1 - 1e-6 THEN 'recovery' ELSE 'neutral' END AS best_class FROM td)"""
_TRI = "x AS (SELECT *, abs(ret) * 100 AS q FROM rows), y AS (SELECT *, greatest(0, least(1, 1 - abs(q) / 0.5)) AS r0, greatest(0, least(1, 1 - abs(q - 0.5) / 0.5)) AS r1, greatest(0, least(1, 1 - abs(q - 1) / 0.5)) AS r2 FROM x), tri AS (SELECT *, " + ", ".join(f"CASE WHEN r0 + r1 + r2 > 0 THEN r{i} / (r0 + r1 + r2) ELSE {float(i == 2)} END AS p{i}" for i in range(3)) + " FROM y)"
_EPI = "ep AS (SELECT user_id, n // 8 AS chunk, n % 8 AS step, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"
_SYM = "sign({x}) * ln(1 + abs({x}))"

ORACLES = {
    "q_backtest_summary": f"{EQS}, {_SUMMARY} SELECT sym, bars, {_round('sharpe', 'bench_sharpe', 'total_return', 'bench_return', 'max_dd', 'bench_dd', 'cost')}, round(total_return - bench_return, 6) AS final_excess, round(sharpe - bench_sharpe, 6) AS sharpe_delta, round(abs(max_dd) - abs(bench_dd), 6) AS maxdd_delta FROM s",
    "q_backtest_full": f"""{EQS}, f0 AS (SELECT *, pos <> lag(pos, 1, 0.0) OVER {W} AS turn, coalesce(pos <> lag(pos) OVER {W}, true) AS starts FROM eq),
f AS (SELECT sym, count(*) AS bars, {_sharpe('pnl')} AS sharpe, CASE WHEN stddev_pop(CASE WHEN pnl < 0 THEN pnl END) IS NULL OR stddev_pop(CASE WHEN pnl < 0 THEN pnl END) < 1e-10 THEN CASE WHEN avg(pnl) > 0 THEN 99 ELSE 0 END ELSE avg(pnl) / stddev_pop(CASE WHEN pnl < 0 THEN pnl END) * sqrt(252) END AS sortino,
 exp(sum(pnl)) - 1 AS total_return, exp(sum(bench_pnl)) - 1 AS bench_return, min(dd) AS max_dd, min(bench_dd) AS bench_max_dd, count_if(turn)::BIGINT AS n_trades, count(*) / count_if(starts) AS avg_hold, avg((pnl > bench_pnl)::DOUBLE) AS bar_win_rate,
 sum(pnl) FILTER (bench_pnl > 0) / sum(bench_pnl) FILTER (bench_pnl > 0) AS up_capture, sum(pnl) FILTER (bench_pnl < 0) / sum(bench_pnl) FILTER (bench_pnl < 0) AS down_capture FROM f0 GROUP BY sym),
g AS (SELECT *, CASE WHEN abs(max_dd) < 1e-10 THEN CASE WHEN total_return > 0 THEN 99 ELSE 0 END ELSE total_return / (bars / 252) / abs(max_dd) END AS calmar, pow(greatest(1 + total_return, 1e-12), 252 / bars) - 1 AS annual_return, pow(greatest(1 + bench_return, 1e-12), 252 / bars) - 1 AS ba FROM f)
SELECT sym, bars, n_trades, {_round('sharpe', 'sortino', 'total_return', 'bench_return', 'max_dd', 'bench_max_dd', 'avg_hold', 'bar_win_rate', 'up_capture', 'down_capture', 'calmar', 'annual_return')}, round(annual_return - ba, 6) AS annual_alpha, round(total_return - bench_return, 6) AS final_excess, round(abs(max_dd) - abs(bench_max_dd), 6) AS maxdd_delta FROM g""",
    "q_equity_curve": f"{EQS} SELECT sym, ts, {_round('pnl', 'equity', 'bench_equity', 'dd')} FROM eq",
    "q_pnl_attribution": f"{PNLS} SELECT sym, round(sum(CASE WHEN pos > 0 THEN pos * ret ELSE 0 END), 6) AS long_gross, round(sum(CASE WHEN pos < 0 THEN pos * ret ELSE 0 END), 6) AS short_gross, round(sum(cost), 6) AS cost_total, round(sum(pnl), 6) AS net_total FROM pnl GROUP BY sym",
    "q_regime_backtest": (EQS.replace("rows AS (", "rows0 AS (", 1).replace("pnl AS (SELECT", "rows AS (SELECT sym AS base, CASE WHEN abs(ret) > 0.005 THEN 'wild' ELSE 'calm' END AS regime, sym || '/' || CASE WHEN abs(ret) > 0.005 THEN 'wild' ELSE 'calm' END AS sym, ts, ret, pos FROM rows0), pnl AS (SELECT", 1))
    + f", n AS (SELECT sym AS base, count(*) AS n FROM rows0 GROUP BY 1) SELECT e.base AS sym, regime, count(*) AS bars, round({_sharpe('pnl')}, 6) AS sharpe, round(exp(sum(pnl)) - 1, 6) AS total_return, round(min(dd), 6) AS max_dd, round(count(*) / max(n), 6) AS fraction FROM eq e JOIN n USING (base) GROUP BY e.base, regime HAVING count(*) >= 10",
    "q_period_win_rate": f"{PNLS}, {_WIN} SELECT sym, periods, round(win_rate, 6) AS win_rate FROM pw",
    "q_underperf_streak": f"{PNLS}, u0 AS (SELECT *, pnl <= bench_pnl AS u FROM pnl), u AS (SELECT *, lag(u) OVER {W} AS w FROM u0), r AS ({_RUNS.format(c='u <> w', t='u')}), l AS (SELECT sym, run, count(*) AS n FROM r WHERE u GROUP BY ALL) SELECT sym, max(n) AS longest_under FROM l GROUP BY sym",
    "q_holding_runs": f"{ROWS}, u AS (SELECT *, lag(pos) OVER {W} AS w FROM rows), r AS ({_RUNS.format(c='pos <> w', t='u')}), l AS (SELECT sym, run, count(*) AS n FROM r GROUP BY ALL) SELECT sym, count(*) AS runs, round(avg(n), 6) AS mean_hold, max(n) AS longest FROM l GROUP BY sym",
    "q_recovery_latency": f"{ROWS}, u0 AS (SELECT *, pos < 1 - 1e-6 AS low FROM rows), u AS (SELECT *, lag(low) OVER {W} AS w FROM u0), r AS ({_RUNS.format(c='low <> w', t='u')}), l AS (SELECT sym, run, bool_or(low) AS low, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT *, max(run) OVER (PARTITION BY sym) AS last FROM l) SELECT sym, count(*) AS runs, round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90 FROM m WHERE low AND run < last GROUP BY sym",
    "q_action_stats": f"{ROWS}, {_STATS} SELECT sym, {_round('step_ref', 'long_share', 'short_share', 'flat_share', 'mean_overlay', 'turnover', 'switches', 'avg_hold')} FROM st",
    "q_maxdd_interval": f"{EQS}, i AS (SELECT *, row_number() OVER {W} - 1 AS i FROM eq), t AS (SELECT sym, arg_min(i, (dd, i)) AS trough, min(dd) AS max_dd FROM i GROUP BY sym) SELECT t.sym, trough, round(max_dd, 6) AS max_dd, arg_max(i, (equity, -i)) AS peak FROM i JOIN t ON i.sym = t.sym AND i.i <= t.trough GROUP BY ALL",
    "q_fire_runs": f"{ROWS}, u0 AS (SELECT *, pos > 1 AS fire, row_number() OVER {W} - 1 AS i FROM rows), u AS (SELECT *, lag(fire) OVER {W} AS w FROM u0), r AS ({_RUNS.format(c='fire <> w', t='u')}) SELECT sym, min(i) AS start, max(i) + 1 AS stop FROM r WHERE fire GROUP BY sym, run",
    "q_trade_markers": f"{ROWS}, u AS (SELECT sym, ts, lag(pos) OVER {W} AS b, pos FROM rows) SELECT sym, ts, round(b, 6) AS before, round(pos, 6) AS after, round(pos - b, 6) AS delta FROM u WHERE abs(pos - b) > 1e-4",
    "q_active_blocks": f"{ROWS}, u0 AS (SELECT *, abs(CASE WHEN abs(ret) > 0.004 THEN pos ELSE 1.0 END - 1) > 0.05 AS o, row_number() OVER {W} - 1 AS i FROM rows), u AS (SELECT *, lag(o) OVER {W} AS w FROM u0), r AS ({_RUNS.format(c='o <> w', t='u')}) SELECT sym, min(i) AS start, max(i) AS \"end\" FROM r WHERE o GROUP BY sym, run",
    "q_fire_metrics": f"{ROWS}, u AS (SELECT *, CASE WHEN abs(ret) > 0.004 THEN 1.0 ELSE pos END::DOUBLE AS base, {_fwd(4, 'sum(ret)')} AS f4, {_fwd(8, 'sum(ret)')} AS f8 FROM rows), v AS (SELECT *, abs(pos - base) > 1e-8 AS fire FROM u) SELECT sym, count_if(fire)::BIGINT AS fires, round(avg(fire::DOUBLE), 6) AS fire_rate, round(coalesce(sum((pos - base) * ret) FILTER (fire), 0), 6) AS incremental, round(avg(f4) FILTER (fire), 6) AS fwd_4, round(avg(f8) FILTER (fire), 6) AS fwd_8 FROM v GROUP BY sym",
    "q_sequence_windows": f"{ROWS}, u AS (SELECT sym, ts, {_fwd(16, 'list(ret)')} AS l FROM rows) SELECT sym, ts, len(l)::INT AS n, round(list_sum(l), 6) AS total, round(l[16], 6) AS last FROM u WHERE len(l) = 16",
    "q_controller_state": f"{ROWS}, o AS (SELECT sym, ts, lag(pos, 1, 1.0) OVER {W} - 1 AS \"over\" FROM rows), d AS (SELECT *, \"over\" - lag(\"over\", 1, 0.0) OVER {W} AS delta, \"over\" < -1e-6 AS low FROM o), e AS (SELECT *, lag(low) OVER {W} AS was, row_number() OVER {W} AS n FROM d), h AS (SELECT *, last_value(CASE WHEN low AND delta > 1e-6 THEN n END IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS rise, sum(CASE WHEN abs(delta) > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS h, sum(CASE WHEN low <> was THEN 1 ELSE 0 END) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS u FROM e) SELECT sym, ts, round(\"over\", 6) AS \"over\", round(delta, 6) AS delta, round(least((row_number() OVER (PARTITION BY sym, h ORDER BY ts) - 1) / 64, 1), 6) AS hold_age, round(coalesce(greatest(0.25 - (n - rise) / 64, 0), 0), 6) AS cooldown, round(CASE WHEN low THEN least(row_number() OVER (PARTITION BY sym, u ORDER BY ts) / 64, 1) ELSE 0 END, 6) AS under_age FROM h",
    "q_forward_stats": f"{ROWS} SELECT sym, ts, round(coalesce({_fwd(8, 'sum(ret)', 1)}, 0), 6) AS fwd_sum, round(coalesce({_fwd(8, 'stddev_pop(ret)', 1)}, 0), 6) AS fwd_std, round({_whole(8, _fwd(8, 'sum(ret)'))}, 6) AS whole_sum, round({_whole(8, _fwd(8, 'stddev_pop(ret)'))} * sqrt(8), 6) AS whole_vol FROM rows",
    "q_forward_dd": f"{ROWS}, u AS (SELECT sym, ts, {_whole(4, _fwd(4, 'list(ret)'))} AS p FROM rows) SELECT sym, ts, round({_dd('p')}, 6) AS fwd_dd FROM u",
    "q_outcome_edge": f"{ROWS} SELECT sym, ts, round(greatest(0, (pos - 1) * 0.5 * (coalesce({_fwd(4, 'sum(ret)', 1)}, 0) + coalesce({_fwd(8, 'sum(ret)', 1)}, 0))), 6) AS edge FROM rows",
    "q_stress_teacher": f"{ROWS}, u AS (SELECT sym, ts, greatest(0, -ret * 100 - 0.2) + 0.5 * greatest(0, abs(ret) * 100 - 0.3) AS stress FROM rows) SELECT sym, ts, round(stress, 6) AS stress, round(greatest(0, least(1, exp(-stress))), 6) AS target FROM u",
    "q_regime_probs": f"{ROWS}, {_TRI} SELECT sym, ts, {_round('p0', 'p1', 'p2')} FROM tri",
    "q_transition_advantage": f"{ROWS}, {_VALUES}, {_BEST} SELECT sym, ts, best_class, {_round('best_target', 'best_value', 'best_advantage')} FROM te",
    "q_transition_matrix": f"{ROWS}, {_VALUES}, {_BEST}, m AS (SELECT CASE WHEN pos < 1 - 1e-6 THEN 'under' WHEN pos > 1 + 1e-6 THEN 'over' ELSE 'flat' END AS now, CASE WHEN best_target < 1 - 1e-6 THEN 'under' WHEN best_target > 1 + 1e-6 THEN 'over' ELSE 'flat' END AS \"then\" FROM te), c AS (SELECT now, \"then\", count(*) AS n FROM m GROUP BY ALL) SELECT now, \"then\", n, round(n / sum(n) OVER (PARTITION BY now), 6) AS rate FROM c",
    "q_transition_summary": f"{ROWS}, {_VALUES}, l AS ({' UNION ALL '.join(f'SELECT {i} AS action, a{i} AS v FROM ta WHERE a{i} IS NOT NULL' for i in range(4))}), q AS (SELECT action, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.9) AS c FROM l GROUP BY 1) SELECT l.action, round(b, 6) AS median, count(*) AS n, round(avg(v), 6) AS mean, round(avg(v) FILTER (v >= c), 6) AS top_mean, round(avg(v) FILTER (v <= a), 6) AS bottom_mean, round(avg((v > 0)::DOUBLE), 6) AS positive_rate FROM l JOIN q USING (action) GROUP BY l.action, b",
    "q_route_summary": f"{ROWS}, {_VALUES}, {_BEST}, r AS (SELECT CASE best_class WHEN 'neutral' THEN 0 WHEN 'recovery' THEN 2 WHEN 'overweight' THEN 3 ELSE 1 END AS route, best_advantage FROM te) SELECT k::INT AS route, count(r.route) AS n, round(coalesce(avg(best_advantage), 0), 6) AS advantage FROM range(4) t(k) LEFT JOIN r ON r.route = k GROUP BY k",
    "q_future_return_targets": f"{ROWS} SELECT sym, ts, round({_whole(4, _fwd(4, 'sum(ret)'))}, 6) AS r4_0, round({_whole(8, _fwd(8, 'sum(ret)', 1), 1)}, 6) AS r8_1 FROM rows",
    "q_future_risk_targets": f"{ROWS}, u AS (SELECT sym, ts, {', '.join(f'lead(ret, {k}) OVER {W} AS r{k}' for k in (1, 2, 3, 4))} FROM rows), w AS (SELECT *, CASE WHEN r4 IS NOT NULL THEN sqrt((r1 * r1 + r2 * r2 + r3 * r3 + r4 * r4) / 4) END AS v, CASE WHEN r4 IS NOT NULL THEN -least(0, r1, r1 + r2, r1 + r2 + r3, r1 + r2 + r3 + r4) END AS d FROM u) SELECT sym, ts, round(v, 6) AS vol_4, round(d, 6) AS depth_4, CASE WHEN d IS NOT NULL THEN (d >= 0.01)::INT END AS crash_4, CASE WHEN d IS NOT NULL THEN round(greatest(d - 0.005, 0), 6) END AS excess_4 FROM w",
    "q_position_utility": f"{ROWS}, u AS (SELECT sym, ts, pos, {_fwd(4, 'stddev_pop(ret)', 1)} AS v, {', '.join(f'lead(ret, {k}) OVER {W} AS r{k}' for k in (1, 2, 3, 4))} FROM rows), w AS (SELECT *, -least(0, r1, r1 + r2, r1 + r2 + r3, r1 + r2 + r3 + r4) AS d FROM u WHERE r4 IS NOT NULL) SELECT sym, ts, a AS action, round((a - 1) * (r1 + r2 + r3 + r4) - {UNIT} * abs(a - pos) - 0.5 * (a * d - d) - 0.1 * abs(a - 1) * v, 6) AS utility FROM w, unnest([0.0, 0.5, 1.0, 1.25]::DOUBLE[]) t(a)",
    "q_oracle_dp": f"""{_REC}, m AS MATERIALIZED (SELECT sym, ts, ret, row_number() OVER (PARTITION BY sym ORDER BY ts DESC) AS n, row_number() OVER {W} AS k FROM rows),
v(sym, n, val, pol) AS (SELECT sym, 0::BIGINT, [0.0, 0.0, 0.0, 0.0]::DOUBLE[], [0, 0, 0, 0]::BIGINT[] FROM (SELECT DISTINCT sym FROM m)
 UNION ALL SELECT sym, n, list_transform(c, lambda l: list_max(l)), list_transform(c, lambda l: list_position(l, list_max(l))::BIGINT) FROM (
  SELECT v.sym, m.n, list_transform([0.0, 0.5, 1.0, 1.25]::DOUBLE[], lambda p: list_transform([1, 2, 3, 4], lambda j: [0.0, 0.5, 1.0, 1.25][j] * m.ret - m.ret + v.val[j] - {UNIT} * abs([0.0, 0.5, 1.0, 1.25][j] - p))) AS c
  FROM v JOIN m ON m.sym = v.sym AND m.n = v.n + 1)),
vm AS MATERIALIZED (SELECT m.sym, m.ts, m.k, v.val, v.pol FROM m JOIN v ON v.sym = m.sym AND v.n = m.n),
f AS (SELECT sym, ts, k, pol[1] AS s, val[1] AS worth FROM vm WHERE k = 1 UNION ALL SELECT x.sym, x.ts, x.k, x.pol[f.s], x.val[f.s] FROM f JOIN vm x ON x.sym = f.sym AND x.k = f.k + 1)
SELECT sym, ts, [0.0, 0.5, 1.0, 1.25][s]::DOUBLE AS best, round(worth, 6) AS value FROM f""",
    "q_min_hold": f"{_REC}, {_TARGETS}, t AS MATERIALIZED (SELECT * FROM tg), h AS (SELECT sym, ts, n, target AS held, 1 AS since FROM t WHERE n = 1 UNION ALL SELECT t.sym, t.ts, t.n, CASE WHEN t.target <> h.held AND h.since >= 5 THEN t.target ELSE h.held END, CASE WHEN t.target <> h.held AND h.since >= 5 THEN 1 ELSE h.since + 1 END FROM h JOIN t ON t.sym = h.sym AND t.n = h.n + 1) SELECT sym, ts, held FROM h",
    "q_execute_targets": f"{_REC}, {_TARGETS}, t AS MATERIALIZED (SELECT *, greatest(0.5, least(1.12, 1 + 0.8 * (target - 1))) AS aim FROM tg), h AS (SELECT DISTINCT sym, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 1.0::DOUBLE AS p, 3 AS since FROM t UNION ALL SELECT sym, ts, n, np, CASE WHEN abs(np - p) > 1e-8 THEN 0 ELSE since + 1 END FROM (SELECT t.sym, t.ts, t.n, h.p, h.since, greatest(0.5, least(1.12, h.p + CASE WHEN h.since < 3 THEN 0 ELSE greatest(-0.04, least(0.04, t.aim - h.p)) END)) AS np FROM h JOIN t ON t.sym = h.sym AND t.n = h.n + 1)) SELECT sym, ts, round(p, 6) AS position FROM h WHERE n > 0",
    "q_deflated_sharpe": f"{PNLS}, m AS (SELECT sym, {_sharpe('pnl')} AS sr, count(*) AS n, avg(pnl) AS mu, stddev_pop(pnl) AS sd FROM pnl GROUP BY sym), k AS (SELECT m.sym, sr, n, avg(pow((pnl - mu) / sd, 3)) AS skew, avg(pow((pnl - mu) / sd, 4)) AS kurt FROM pnl JOIN m USING (sym) GROUP BY ALL) SELECT sym, round(sr, 4) AS sr, n, round(skew, 4) AS skew, round(kurt, 4) AS kurt, round((sr - {overfit.expected_maximum(10)!r}) / sqrt(greatest((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / greatest(n - 1, 1), 1e-10)), 4) AS z FROM k",
    "q_scorecard": f"{EQS}, {_SUMMARY}, {_STATS}, {_WIN}, j AS (SELECT s.sym, 100 * (total_return - bench_return) AS alpha_pt, 100 * (abs(max_dd) - abs(bench_dd)) AS maxdd_pt, sharpe - bench_sharpe AS sharpe_delta, win_rate, long_share, short_share, switches, turnover FROM s JOIN st USING (sym) JOIN pw USING (sym)), c AS (SELECT *, alpha_pt >= 3 AS ok_alpha, sharpe_delta >= 0.2 AS ok_sharpe, maxdd_pt <= -3 AS ok_maxdd, win_rate >= 0.6 AS ok_win_rate, NOT (greatest(long_share, short_share) >= 0.8 AND switches <= 5 AND turnover < 1) AS ok_collapse, alpha_pt >= 10 OR maxdd_pt <= -5 AS stretch_hit FROM j) SELECT sym, {_round('alpha_pt', 'maxdd_pt', 'sharpe_delta', 'win_rate')}, ok_alpha, ok_sharpe, ok_maxdd, ok_win_rate, ok_collapse, stretch_hit, ok_alpha AND ok_sharpe AND ok_maxdd AND ok_win_rate AND ok_collapse AS m2_pass FROM c",
    "q_pbo": f"{ROWS}, {FOLDS}, fr AS (SELECT r.*, fold FROM rows r JOIN folds f ON ts >= test_start AND ts <= test_end), p AS (SELECT fold, pos * ret - {UNIT} * abs(pos - lag(pos, 1, 0.0) OVER (PARTITION BY sym, fold ORDER BY ts)) AS pnl FROM fr), s AS (SELECT fold, CASE WHEN stddev_pop(pnl) < 1e-10 THEN 0 ELSE avg(pnl) / stddev_pop(pnl) END AS s FROM p GROUP BY fold), l AS (SELECT list(s ORDER BY fold) AS s, count(*) AS n FROM s), m AS (SELECT s, n, mask FROM (SELECT s, n, unnest(range(1 << n)) AS mask FROM l) WHERE bit_count(mask) = n // 2), o AS (SELECT list_max(list_filter(s, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS a, list_max(list_filter(s, lambda x, i: (mask >> (i - 1)) & 1 = 0)) AS b FROM m) SELECT round(avg((a > b)::DOUBLE), 6) AS pbo, count(*) AS subsets FROM o",
    "q_support_counts": f"{ROWS}, u AS (SELECT CASE WHEN abs(ret) > 0.005 THEN 1 ELSE 0 END AS regime, CASE WHEN pos = 0.5 THEN 1 ELSE 2 END AS now, CASE WHEN lead(pos) OVER {W} = 0.5 THEN 1 WHEN lead(pos) OVER {W} IS NOT NULL THEN 2 END AS next FROM rows) SELECT regime, now, next, count(*) AS n FROM u WHERE next IS NOT NULL GROUP BY ALL",
    "q_regime_prior": f"{ROWS}, {_TRI}, l AS ({' UNION ALL '.join(f'SELECT {i} AS regime, p{i} AS p, (ret > 0.002)::DOUBLE AS y FROM tri' for i in range(3))}), b AS (SELECT avg((ret > 0.002)::DOUBLE) AS base FROM rows), g AS (SELECT regime, sum(p) AS mass, sum(p * y) / sum(p) AS r FROM l GROUP BY 1), h AS (SELECT regime, mass, base, base + mass / (mass + 64) * (r - base) AS rate FROM g, b) SELECT regime, round(mass, 6) AS mass, round(rate, 6) AS rate, round(ln(greatest(least(rate, 1 - 1e-6), 1e-6) / (1 - greatest(least(rate, 1 - 1e-6), 1e-6))) - ln(base / (1 - base)), 6) AS logit FROM h",
    "q_lambda_return": f"WITH {_EPI}, a AS (SELECT user_id, chunk, list(value ORDER BY step) AS v FROM ep GROUP BY ALL HAVING count(*) = 8), g AS (SELECT user_id, chunk, list_transform(v, lambda x: {_SYM.format(x='(x / 100 - 0.5)')}) AS r, list_transform(v, lambda x: {_SYM.format(x='(x / 200)')}) AS u FROM a), h7 AS (SELECT *, r[8] + 0.99 * (0.05 * u[8] + 0.95 * u[8]) AS g7 FROM g), " + ", ".join(f"h{k} AS (SELECT *, r[{k + 1}] + 0.99 * (0.05 * u[{k + 1}] + 0.95 * g{k + 1}) AS g{k} FROM h{k + 1})" for k in range(6, -1, -1)) + " SELECT user_id, chunk, round(g0, 6) AS g0, round(g7, 6) AS g7 FROM h0",
    "q_rollout_rewards": f"WITH {_EPI}, s AS (SELECT user_id, chunk, step, value / 1e4 - 0.005 AS ret, CASE WHEN step % 3 = 0 THEN 1.1 ELSE 0.8 END::DOUBLE AS pos FROM ep), n AS (SELECT *, pos * ret - {UNIT} * abs(pos - lag(pos, 1, 1.0) OVER w) AS net FROM s WINDOW w AS (PARTITION BY user_id, chunk ORDER BY step)), c AS (SELECT *, sum(net) OVER (PARTITION BY user_id, chunk ORDER BY step ROWS UNBOUNDED PRECEDING) AS c FROM n), l AS (SELECT *, max(c) OVER (PARTITION BY user_id, chunk ORDER BY step ROWS UNBOUNDED PRECEDING) - c AS level FROM c), r AS (SELECT *, net - ret - 0.5 * greatest(level - lag(level, 1, 0.0) OVER (PARTITION BY user_id, chunk ORDER BY step), 0) - 0.1 * greatest(pos - 1, 0) AS reward FROM l) SELECT user_id, chunk, round(sum(reward), 9) AS reward, round(max(level), 9) AS level FROM r GROUP BY ALL",
    "q_twohot": f"{ROWS}, u AS (SELECT sym, ts, (greatest(-3, least(3, {_SYM.format(x='(ret * 100)')})) + 3) / 0.2 AS a FROM rows) SELECT sym, ts, least(floor(a), 29)::INT AS bin, round(a - least(floor(a), 29), 6) AS upper FROM u",
    "q_knn_anchor": "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS anchor, list_distance(a.v, b.v) AS d FROM u a, (SELECT u.* FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) JOIN u USING (vec_id) WHERE i IN (SELECT ((k * ((SELECT count(*) FROM embeddings) - 1)) // 31) FROM range(32) t(k))) b) SELECT vec_id, arg_min(anchor, (d, anchor)) AS anchor, round(min(d), 5) AS distance FROM d GROUP BY vec_id",
}


def _term(h: int) -> str:
    total, dev = _fwd(h, "sum(ret)", 1), _fwd(h, "stddev_pop(ret)", 1)
    return f"coalesce({total}, 0) / 3 / (sqrt({h}) * (coalesce({dev}, 0) + 1e-6))"


_LOSSES = _fwd(8, "avg((ret < 0)::DOUBLE)", 1)
_AIM = f"""{_REC}, {_TARGETS}, s0 AS (SELECT *, min(CASE WHEN target >= 1 THEN n END) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop, max(CASE WHEN target >= 1 THEN n END) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS was, max(n) OVER (PARTITION BY sym) AS last, greatest(0.3, least(1.12, target)) AS c FROM tg),
s1 AS (SELECT *, coalesce(stop, last + 1) - n AS fr, n - coalesce(was, 0) AS streak FROM s0), s2 AS (SELECT *, CASE WHEN c < 1 THEN least(1, greatest(streak, fr) / 3) ELSE 1 END AS share FROM s1),
s3 AS MATERIALIZED (SELECT sym, ts, n, fr, CASE WHEN 1 + (c - 1) * share < 1 THEN greatest(1 + (c - 1) * share, 0.45) ELSE 1 + (c - 1) * share END AS aim, 0.1 * CASE WHEN c < 1 THEN greatest(share, 0.5) ELSE 1 END AS most FROM s2),
h AS (SELECT DISTINCT sym, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 0::BIGINT AS fr, 1.0::DOUBLE AS p FROM s3 UNION ALL SELECT t.sym, t.ts, t.n, t.fr, CASE WHEN abs(t.aim - h.p) <= 0.02 THEN h.p ELSE greatest(0.3, least(1.12, h.p + greatest(-t.most, least(t.most, t.aim - h.p)))) END FROM h JOIN s3 t ON t.sym = h.sym AND t.n = h.n + 1)"""
ORACLES["q_smooth_aim"] = f"{_AIM} SELECT sym, ts, fr::DOUBLE AS future_run, round(p, 6) AS aim FROM h WHERE n > 0"
_GRID = (-1.0, -0.25, 0.0, 0.5, 1.0)


def _hat(i: int) -> str:
    rise = f"(x - ({_GRID[i - 1]})) / {_GRID[i] - _GRID[i - 1]}" if i else "1"
    fall = f"({_GRID[i + 1]} - x) / {_GRID[i + 1] - _GRID[i]}" if i + 1 < len(_GRID) else "1"
    return f"round(greatest(0, least({rise}, {fall}, 1)), 6) AS s{i}"


ORACLES["q_soft_label"] = f"{ROWS}, u AS (SELECT sym, ts, greatest(-1, least(1, ret * 100)) AS x FROM rows) SELECT sym, ts, {', '.join(map(_hat, range(5)))} FROM u"
ORACLES["q_signal_teacher"] = f"{ROWS}, u AS (SELECT sym, ts, greatest(-4, least(4, {' + '.join(map(_term, (4, 8, 16)))} - 0.5 * coalesce({_LOSSES}, 0))) AS signal FROM rows) SELECT sym, ts, round(signal, 5) AS signal, round(greatest(0, least(1, exp(-greatest(0, -(signal + 0.1))))), 5) AS target FROM u"
