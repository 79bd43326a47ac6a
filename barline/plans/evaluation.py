"""Queries on execution grids, candidates, fold tables, fires, rewards and small table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.frames import ordered, round_to
from barline.operators import backtest, chunks, evaluate, folds, rewards, scans, selection
from barline.plans.paths import _EPI, _REC, _SYM, W, _episodes, rows
from barline.plans.views import CANDIDATES, EXPANDED, FOLDS, RETS, ROWS, SPECS, UNIT
from barline.sources import bars

KEYS = ("sym", "fold", "spec")


def _targets(spark, sf):
    """Volatility targets of each fold's validation and test rows, by the median of its training volatility."""
    rets = bars.returns_1d(spark, sf)
    rms = F.sqrt(F.avg(F.pow(F.coalesce(F.lag("ret").over(ordered()), F.lit(0.0)), F.lit(2))).over(ordered().rowsBetween(-19, 0)))
    fr = folds.expand(rets.withColumn("vol", rms), folds.bar_splits(rets))
    level = fr.where("role = 'train'").groupBy("sym", "fold").agg(F.percentile("vol", F.lit(0.5)).alias("level"))
    goal = F.greatest(F.lit(0.5), F.least(F.lit(1.12), F.col("level") / F.greatest(F.col("vol"), F.lit(1e-8))))
    return fr.where("role <> 'train'").join(level, ["sym", "fold"]).withColumn("target", goal)


def _executed(df, specs=SPECS):
    paths = [f"p{i}" for i in range(len(specs))]
    wide = scans.scan(df.select("sym", "fold", "role", "ts", "ret", "target"), lambda t: scans.execute_grid(t, specs), ("target",), tuple(paths), by=("sym", "fold", "role"))
    return wide.select("sym", "fold", "role", "ts", "ret", F.posexplode(F.array(*paths)).alias("spec", "pos"))


def _chosen(spark, sf):
    """Test rows under the setting that did best on the fold's validation rows."""
    df = _executed(_targets(spark, sf))
    val = df.where("role = 'val'")
    turn = val.withColumn("d", F.abs(F.col("pos") - F.lag("pos").over(ordered(KEYS)))).groupBy(*KEYS).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("turnover"))
    m = backtest.summary(val, KEYS).join(turn, list(KEYS)).withColumns({"alpha_pt": 100 * F.col("final_excess"), "maxdd_pt": 100 * F.col("maxdd_delta")})
    best = evaluate.best_spec(round_to(m.select(*KEYS, "alpha_pt", "maxdd_pt", "turnover"), 5), ("sym", "fold"))
    return df.where("role = 'test'").join(best, list(KEYS))


def q_execution_grid(spark, sf):
    df = _chosen(spark, sf)
    choice = df.select(*KEYS, "score").distinct()
    return round_to(backtest.summary(df, KEYS).join(choice, list(KEYS)).select(*KEYS, "score", "bars", "total_return", "final_excess", "maxdd_delta"), 5)


def _figures(spark, sf):
    """Figures of each fold's test rows, for all settings and for holding the benchmark."""
    df = _executed(_targets(spark, sf).where("role = 'test'"), CANDIDATES)
    return round_to(evaluate.figures(df, 21, KEYS), 5)


def _candidates(spark, sf):
    return evaluate.candidates(_figures(spark, sf), min_hold=1.0, max_turnover=2.0)


def q_selector_candidates(spark, sf):
    return round_to(_candidates(spark, sf).select(*KEYS, "hold", "reject", "m2_pass", "stretch_hit", "score"), 6)


def q_policy_score(spark, sf):
    return round_to(_figures(spark, sf).select(*KEYS, evaluate.policy_score(1.0).alias("overlay_score"), evaluate.policy_score(0.0).alias("plain_score")), 6)


def q_selected_policy(spark, sf):
    df = _candidates(spark, sf).withColumns({"cand": F.col("spec"), "score": F.round("score", 6)})
    out = [selection.choose(df, ("sym", "fold"), mode).select("sym", "fold", F.lit(mode).alias("mode"), "cand") for mode in ("conservative", "balanced", "score")]
    return out[0].union(out[1]).union(out[2])


def q_selector_choice(spark, sf):
    df = _candidates(spark, sf).withColumns({"cand": F.col("spec"), "score": F.round("score", 6)})
    return round_to(selection.choose(df, ("sym", "fold")).select("sym", "fold", "cand", "score", "reject"), 6)


def q_scorecard_totals(spark, sf):
    cards = selection.scorecard(_figures(spark, sf))
    return round_to(evaluate.aggregate_scorecards(cards, ("spec",)), 5)


def q_fold_table(spark, sf):
    df = rows(spark, sf)
    splits = folds.bar_splits(df)
    return round_to(evaluate.fold_table(folds.expand(df, splits).where("role = 'test'"), splits), 5)


def _fired(spark, sf):
    """A path that leaves its base path after large gains."""
    late = F.lag("ret").over(ordered())
    return rows(spark, sf).withColumns({"base": F.lit(1.0), "pos": F.when(late > 0.004, 1.1).when(late < -0.006, 0.7).otherwise(1.0)})


def q_component_attribution(spark, sf):
    df = _fired(spark, sf).withColumn("half", (F.col("pos") + 1) / 2)
    return round_to(evaluate.component_attribution(df, {"no_adapter": "base", "half": "half"}), 7)


def q_fire_dangers(spark, sf):
    return round_to(evaluate.fire_dangers(_fired(spark, sf), horizon=8, vol_window=16).select("sym", "ts", "advantage", "post_dd", "overlap", "pre_dd"), 7)


def q_fire_danger_summary(spark, sf):
    return round_to(evaluate.danger_summary(_fired(spark, sf), horizon=8, vol_window=16))


def q_fire_candidates(spark, sf):
    return round_to(evaluate.fire_candidates(_fired(spark, sf), horizon=8), 5)


def q_differential_sharpe(spark, sf):
    """Large values, near a variance of nothing, are rounded to ten thousands."""
    x = F.col("dsr")
    df = chunks.differential_sharpe(rows(spark, sf), scale=100.0)
    return df.select("sym", "ts", F.when(F.abs(x) < 1e6, F.round(x, 3) + 0.0).otherwise(F.round(x / 1e4) * 1e4).alias("dsr"))


def q_rate_cap(spark, sf):
    df = rows(spark, sf).withColumn("fire", (F.abs("ret") > 0.004).cast("double"))
    return scans.scan(df, lambda x: scans.rate_cap(x, 0.1), ("fire",), ("kept",)).select("sym", "ts", F.col("kept").cast("int").alias("kept"))


def q_soft_executor(spark, sf):
    df = rows(spark, sf).withColumns({"aim": F.when(F.col("ret") > 0, 1.1).otherwise(0.7), "rate": F.abs("ret") * 100, "band": F.lit(0.05)})
    return round_to(scans.scan(df, lambda a, r, b: scans.soft_path(a, r, b, 0.1, 1.0, 0.5, 1.12), ("aim", "rate", "band"), ("position",)).select("sym", "ts", "position"))


def q_fingerprint(spark, sf):
    df = bars.read(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").alias("ts"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return evaluate.fingerprint(df, ("o_orderpriority",))


def q_evenly_spaced(spark, sf):
    return round_to(evaluate.evenly_spaced(rows(spark, sf).select("sym", "ts", "ret"), 100))


def q_running_best(spark, sf):
    df = _episodes(spark, sf).select("user_id", F.col("n").alias("step"), "value")
    return round_to(evaluate.running_best(df, "value", 5, ("user_id",)).select("user_id", "step", "best_step", "best"))


def q_fold_coverage(spark, sf):
    """Folds that have rows in all roles, and wanted folds that are missing."""
    rets = bars.returns_1d(spark, sf)
    splits = folds.bar_splits(rets)
    whole = folds.complete(folds.expand(rets, splits))
    wanted = spark.createDataFrame([(k,) for k in folds.parse_folds("0-3,9,90")], "fold int")
    return whole.withColumn("state", F.lit("whole")).union(folds.missing(wanted, whole).withColumn("state", F.lit("missing")))


def q_support_lookup(spark, sf):
    """Each row's count of like transitions (regime, present and next action), 0 where there is none."""
    from barline.operators import labels

    df = rows(spark, sf).withColumns({"regime": F.when(F.abs("ret") > 0.005, 1).otherwise(0), "now": labels.nearest(F.col("pos"))})
    df = df.withColumn("next", F.lead("now").over(ordered()))
    seen = df.where("next is not null").groupBy("regime", "now", "next").agg(F.count(F.lit(1)).alias("support"))
    found = df.join(F.broadcast(seen), ["regime", "now", "next"], "left")  # a few regimes and actions
    return found.select("sym", "ts", F.coalesce("support", F.lit(0)).alias("support"))


def q_dsr_pvalue(spark, sf):
    from barline.operators import overfit

    z = F.col("ret") * 200
    return round_to(rows(spark, sf).select("sym", "ts", overfit.p_value(z).alias("p")), 5)


def _steps(spark, sf):
    df = _episodes(spark, sf)
    pos = F.when(F.col("step") % 3 == 0, 0.1).otherwise(-0.2)
    return df.select("user_id", "chunk", "step", (F.col("value") / 1e4 - 0.005).alias("bench_net"), ((F.col("value") / 1e4 - 0.005) * (1 + pos)).alias("net"), pos.alias("over"), (F.col("value") / 100).alias("risk"), (F.col("value") / 200 - 0.2).alias("edge"))


def q_reward_functionals(spark, sf):
    by, df = ("user_id", "chunk"), _steps(spark, sf)
    weights = {"dd": 0.5, "dd_budget": 0.001, "dd_better": 0.2, "end_dd": 0.1, "end_better": 0.05, "floor": 0.002, "floor_weight": 0.3, "tail": 0.4, "tail_margin": 0.001, "level": 0.1, "downside": 0.2}
    own = {"l2": 0.01, "short": 0.02, "over": 0.03, "absolute": 0.001, "risk": 0.002, "tilt": 0.003, "edge": 0.004}
    sums = []
    for kind in ("budget", "relative", "absolute"):
        out = rewards.constrained_rewards(df, kind, 2.0, by, weights, own)
        sums.append(out.groupBy(*by).agg(F.sum("reward").alias(kind)))
    plain = rewards.drawdown_rewards(df, 0.3, 2.0, by).groupBy(*by).agg(F.sum("reward").alias("plain"))
    return round_to(sums[0].join(sums[1], list(by)).join(sums[2], list(by)).join(plain, list(by)), 8)


def q_reward_scale(spark, sf):
    df = _episodes(spark, sf).select("user_id", F.floor(F.col("n") / 16).alias("batch"), (F.col("value") / 7).alias("net"))
    return round_to(rewards.reward_scale(df, by=("user_id",)))


def q_twohot_roundtrip(spark, sf):
    x = F.col("ret") * 300
    t = rewards.two_hot(rewards.symlog(x), -3.0, 3.0, 31)
    back = rewards.symexp(rewards.two_hot_value(t["bin"], t["upper"], -3.0, 3.0, 31))
    return round_to(rows(spark, sf).select("sym", "ts", back.alias("back")))


def q_masked_losses(spark, sf):
    df = rows(spark, sf).withColumns({"p": F.lag("ret").over(ordered()) * 300, "t": F.col("ret") * 300, "up": (F.col("ret") > 0).cast("double")})
    pair = lambda c: F.array(F.lit(0.0), F.col(c), -F.col(c))
    return round_to(rewards.masked_losses(df, {
        "l1": (rewards.smooth_l1(F.col("p"), F.col("t")), F.abs("t") > 0.1), "bce": (rewards.bce_with_logits(F.col("p"), F.col("up"), 2.0), F.lit(True)), "rank": (rewards.ranking_loss(pair("p"), pair("t")), F.col("pos") > 1),
    }, ("sym",)))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_P = "(PARTITION BY sym ORDER BY ts ROWS"
_TARGET_SQL = f"""{RETS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {FOLDS}, vol AS (SELECT *, sqrt(avg(pow(x, 2)) OVER {_P} 19 PRECEDING)) AS vol FROM (SELECT *, coalesce(lag(ret) OVER {W}, 0.0) AS x FROM rets)), {EXPANDED.replace('FROM rets r', 'FROM vol r')},
lv AS (SELECT sym, fold, quantile_cont(vol, 0.5) AS level FROM fr WHERE role = 'train' GROUP BY ALL),
tg AS (SELECT sym, fold, role, ts, ret, greatest(0.5, least(1.12, level / greatest(vol, 1e-8))) AS target FROM fr JOIN lv USING (sym, fold) WHERE role <> 'train')"""


def _grid_sql(specs, where: str = "true") -> str:
    """Positions of each setting, a fold over each group's rows in order."""
    values = ", ".join(f"({i}, {b}::DOUBLE, {s}::DOUBLE, {h})" for i, (b, s, h) in enumerate(specs))
    return f"""{_TARGET_SQL}, sp AS (SELECT * FROM (VALUES {values}) v(spec, blend, step, hold)),
gt AS MATERIALIZED (SELECT sym, fold, role, spec, ts, ret, step, hold, greatest(0.5, least(1.12, 1 + blend * (target - 1))) AS aim, row_number() OVER (PARTITION BY sym, fold, role, spec ORDER BY ts) AS n FROM tg, sp WHERE {where}),
gh AS (SELECT DISTINCT sym, fold, role, spec, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS ret, 1.0::DOUBLE AS pos, hold AS idle FROM gt
 UNION ALL SELECT sym, fold, role, spec, n, ts, ret, np, CASE WHEN abs(np - pos) > 1e-8 THEN 0 ELSE idle + 1 END FROM (SELECT t.sym, t.fold, t.role, t.spec, t.n, t.ts, t.ret, h.pos, h.idle, CASE WHEN h.idle < t.hold THEN h.pos ELSE greatest(0.5, least(1.12, h.pos + greatest(-t.step, least(t.step, t.aim - h.pos)))) END AS np FROM gh h JOIN gt t ON t.sym = h.sym AND t.fold = h.fold AND t.role = h.role AND t.spec = h.spec AND t.n = h.n + 1)),
grid AS MATERIALIZED (SELECT sym, fold, role, spec, ts, ret, pos FROM gh WHERE n > 0)"""


def _sharpe(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) < 1e-10 THEN 0 ELSE avg({x}) / stddev_pop({x}) * sqrt(252) END"


def summary_sql(source: str, keys: str, p: str = "x") -> str:
    """Views of a backtest by ``keys``: {p}_pnl, {p}_eq, {p}_s (figures), {p}_st (actions) and {p}_w (win rate of 21 bars)."""
    w = f"(PARTITION BY {keys} ORDER BY ts)"
    r = f"(PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"""{p}_pnl AS (SELECT *, {UNIT} * abs(pos - lag(pos, 1, 0.0) OVER {w}) AS cost, pos * ret - {UNIT} * abs(pos - lag(pos, 1, 0.0) OVER {w}) AS pnl, ret - CASE WHEN row_number() OVER {w} = 1 THEN {UNIT} ELSE 0.0 END AS bench_pnl, abs(pos - lag(pos) OVER {w}) AS move, (row_number() OVER {w} - 1) // 21 AS block, lag(pos, 1, 0.0) OVER {w} AS was FROM {source}),
{p}_e0 AS (SELECT *, exp(sum(pnl) OVER {r}) AS equity, exp(sum(bench_pnl) OVER {r}) AS bench_equity FROM {p}_pnl),
{p}_eq AS (SELECT *, (equity - max(equity) OVER {r}) / (max(equity) OVER {r} + 1e-8) AS dd, (bench_equity - max(bench_equity) OVER {r}) / (max(bench_equity) OVER {r} + 1e-8) AS bench_dd FROM {p}_e0),
{p}_s0 AS (SELECT {keys}, count(*) AS bars, {_sharpe('pnl')} AS sharpe, {_sharpe('bench_pnl')} AS bench_sharpe, exp(sum(pnl)) - 1 AS total_return, exp(sum(bench_pnl)) - 1 AS bench_return, min(dd) AS max_dd, min(bench_dd) AS bench_dd, count_if(pos <> was)::BIGINT AS n_trades,
 CASE WHEN coalesce(stddev_pop(CASE WHEN pnl < 0 THEN pnl END), 0) < 1e-10 THEN CASE WHEN avg(pnl) > 0 THEN 99 ELSE 0 END ELSE avg(pnl) / stddev_pop(CASE WHEN pnl < 0 THEN pnl END) * sqrt(252) END AS sortino FROM {p}_eq GROUP BY {keys}),
{p}_s AS (SELECT *, total_return - bench_return AS final_excess, sharpe - bench_sharpe AS sharpe_delta, abs(max_dd) - abs(bench_dd) AS maxdd_delta, CASE WHEN abs(max_dd) < 1e-10 THEN CASE WHEN total_return > 0 THEN 99 ELSE 0 END ELSE total_return / (bars / 252) / abs(max_dd) END AS calmar FROM {p}_s0),
{p}_ref AS (SELECT {keys}, greatest(coalesce(quantile_cont(CASE WHEN move > 1e-8 THEN move END, 0.9), 0), 0.05) AS ref FROM {p}_pnl GROUP BY {keys}),
{p}_st AS (SELECT {keys}, avg((pos - 1 > 0.05)::DOUBLE) AS long_share, avg((pos - 1 < -0.05)::DOUBLE) AS short_share, avg((abs(pos - 1) <= 0.05)::DOUBLE) AS flat_share, coalesce(sum(move), 0) AS turnover, coalesce(sum(round_even(move / ref, 0)), 0) AS switches, count(*) / greatest(coalesce(sum(round_even(move / ref, 0)), 0), 1) AS avg_hold FROM {p}_pnl JOIN {p}_ref USING ({keys}) GROUP BY {keys}),
{p}_w AS (SELECT {keys}, avg((a > 0)::DOUBLE) AS win_rate FROM (SELECT {keys}, block, sum(pnl) - sum(bench_pnl) AS a FROM {p}_pnl GROUP BY {keys}, block) GROUP BY {keys})"""


def _rounded(names, digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


K = "sym, fold, spec"
_FIGURES = f"""{_grid_sql(CANDIDATES, "role = 'test'")}, {summary_sql('grid', K)},
fig AS (SELECT {K}, round(100 * final_excess, 5) AS alpha_pt, round(sharpe_delta, 5) AS sharpe_delta, round(abs(max_dd), 5) AS depth, round(100 * maxdd_delta, 5) AS maxdd_pt, round(win_rate, 5) AS win_rate, round(long_share, 5) AS long_share, round(short_share, 5) AS short_share, round(flat_share, 5) AS flat_share, round(turnover, 5) AS turnover, round(switches, 5) AS switches, round(avg_hold, 5) AS avg_hold FROM x_s JOIN x_st USING ({K}) JOIN x_w USING ({K})),
card AS (SELECT *, alpha_pt >= 3 AS ok_alpha, sharpe_delta >= 0.2 AS ok_sharpe, maxdd_pt <= -3 AS ok_maxdd, win_rate >= 0.6 AS ok_win_rate, NOT (greatest(long_share, short_share) >= 0.8 AND switches <= 5 AND turnover < 1) AS ok_collapse, alpha_pt >= 10 OR maxdd_pt <= -5 AS stretch_hit, flat_share >= 0.95 AND switches = 0 AS hold FROM fig)"""
_CANDIDATES = f"""{_FIGURES}, cd0 AS (SELECT *, ok_alpha AND ok_sharpe AND ok_maxdd AND ok_win_rate AND ok_collapse AS m2_pass, CASE WHEN hold THEN NULL WHEN alpha_pt <= -25 THEN 'alpha' WHEN sharpe_delta <= -1 THEN 'sharpe' WHEN maxdd_pt > 5 THEN 'maxdd' WHEN win_rate < 0.35 THEN 'win' WHEN turnover > 2 THEN 'turnover' WHEN long_share > 1 THEN 'long' WHEN short_share > 1 THEN 'short' WHEN avg_hold < 1 THEN 'avg_hold' WHEN NOT ok_collapse THEN 'collapse' WHEN greatest(long_share, short_share) >= 1.01 THEN 'one_sided' END AS reject FROM card),
cd AS (SELECT *, 2 * alpha_pt + 5 * sharpe_delta - 3 * turnover - 50 * depth - 1.5 * greatest(maxdd_pt, 0) + 0.5 * greatest(-maxdd_pt, 0) + 20 * (win_rate - 0.5) - CASE WHEN hold THEN 0 ELSE 80 * greatest(greatest(long_share, short_share) - 0.9, 0) END
 + CASE WHEN m2_pass THEN 15 WHEN stretch_hit THEN 5 ELSE 0 END + CASE WHEN hold THEN 0.5 ELSE 0 END - CASE WHEN reject IS NOT NULL THEN 500 ELSE 0 END AS score FROM cd0)"""
_CHOSEN = f"""{_grid_sql(SPECS)}, val AS (SELECT * FROM grid WHERE role = 'val'), {summary_sql('val', K, 'v')}, vm AS (SELECT {K}, round(100 * final_excess, 5) AS a, round(100 * maxdd_delta, 5) AS d, round(coalesce(t, 0), 5) AS t FROM v_s JOIN (SELECT {K}, sum(move) AS t FROM v_pnl GROUP BY {K}) USING ({K})),
vs AS (SELECT {K}, round(2 * a - 6 * greatest(d, 0) + 2 * greatest(-d, 0) - 0.5 * t, 9) AS score FROM vm), best AS (SELECT sym, fold, arg_max(spec, (score, -spec)) AS spec, max(score) AS score FROM vs GROUP BY sym, fold),
picked AS (SELECT g.sym, g.fold, g.spec, ts, ret, pos FROM grid g JOIN best USING (sym, fold, spec) WHERE role = 'test'), {summary_sql('picked', K)}"""
_FIRED = f"{ROWS.replace('rows AS (', 'rows0 AS (', 1)}, rows AS (SELECT sym, ts, ret, 1.0::DOUBLE AS base, CASE WHEN lag(ret) OVER {W} > 0.004 THEN 1.1 WHEN lag(ret) OVER {W} < -0.006 THEN 0.7 ELSE 1.0 END::DOUBLE AS pos, row_number() OVER {W} - 1 AS i FROM rows0)"
_NET = "{p} * ret - " + f"{UNIT} * abs({{p}} - lag({{p}}, 1, 0.0) OVER {W})"
_DANGER = f"""{_FIRED}, f0 AS (SELECT *, abs(pos - base) > 1e-6 AS fire, {_NET.format(p='pos')} AS p_on, {_NET.format(p='base')} AS p_off, coalesce(stddev_pop(ret) OVER {_P} BETWEEN 16 PRECEDING AND 1 PRECEDING), 0) AS vol, count(*) OVER (PARTITION BY sym) AS total FROM rows),
f1 AS (SELECT *, min(CASE WHEN NOT fire THEN i END) OVER {_P} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM f0), f2 AS (SELECT *, coalesce(stop, total) AS run_end FROM f1), ff AS (SELECT * FROM f2 WHERE fire AND i + 8 <= total),
k0 AS (SELECT a.sym, a.i, b.i - a.i AS k, sum(b.p_on) OVER q AS c_on, sum(b.p_off) OVER q AS c_off FROM ff a JOIN f2 b ON a.sym = b.sym AND b.i >= a.i AND b.i < a.i + 8 WINDOW q AS (PARTITION BY a.sym, a.i ORDER BY b.i ROWS UNBOUNDED PRECEDING)),
k1 AS (SELECT *, 1 - exp(c_on - max(c_on) OVER q) AS d_on, 1 - exp(c_off - max(c_off) OVER q) AS d_off, max(c_on) OVER q AS top FROM k0 WINDOW q AS (PARTITION BY sym, i ORDER BY k ROWS UNBOUNDED PRECEDING)),
k2 AS (SELECT sym, i, max(d_on) AS worst, arg_min(k, (-d_on, k)) AS trough, greatest(0, max(d_on - d_off)) AS post_dd, arg_max(c_on, k) - arg_max(c_off, k) AS advantage FROM k1 GROUP BY ALL),
k3 AS (SELECT k2.*, CASE WHEN worst > 0 THEN (SELECT min(x.k) FROM k1 x WHERE x.sym = k2.sym AND x.i = k2.i AND x.c_on = (SELECT y.top FROM k1 y WHERE y.sym = k2.sym AND y.i = k2.i AND y.k = k2.trough)) ELSE 0 END AS peak FROM k2),
fd AS (SELECT ff.sym, ff.ts, ff.i, ff.p_on, advantage, post_dd, worst > 0.5 * greatest(vol * sqrt(8), 1e-8) AS deep, peak, greatest(0, least(7, run_end - ff.i - 1)) AS stop_at FROM ff JOIN k3 USING (sym, i)),
fdd AS (SELECT *, deep AND peak <= stop_at AS overlap, deep AND peak > stop_at AND peak <= greatest(stop_at + 1, 4) AS pre_dd FROM fd)"""
_TESTED = f"""{_grid_sql(SPECS, "role = 'test'")}, {summary_sql('grid', K)}"""
_EP = f"WITH {_EPI}, s AS (SELECT user_id, chunk, step, value / 1e4 - 0.005 AS b, (value / 1e4 - 0.005) * (1 + CASE WHEN step % 3 = 0 THEN 0.1 ELSE -0.2 END) AS n, CASE WHEN step % 3 = 0 THEN 0.1 ELSE -0.2 END::DOUBLE AS o, value / 100 AS risk, value / 200 - 0.2 AS edge FROM ep)"
_Q = "(PARTITION BY user_id, chunk ORDER BY step ROWS UNBOUNDED PRECEDING)"
_A = "(PARTITION BY user_id, chunk)"

_CHOICE = f"""{_CANDIDATES}, c0 AS (SELECT * REPLACE (round(score, 6) AS score) FROM cd), c1 AS (SELECT *, max((reject IS NULL)::INT) OVER (PARTITION BY sym, fold) AS ok FROM c0), pool AS (SELECT * FROM c1 WHERE ok = 0 OR reject IS NULL),
b AS (SELECT sym, fold, arg_max(spec, (score, -spec)) AS bs, min(CASE WHEN hold THEN spec END) AS hs FROM pool GROUP BY ALL), bb AS (SELECT b.*, p.score, p.alpha_pt, p.sharpe_delta, p.maxdd_pt, p.win_rate, p.m2_pass, p.stretch_hit, p.hold, h.score AS hscore FROM b JOIN pool p ON p.sym = b.sym AND p.fold = b.fold AND p.spec = bs LEFT JOIN pool h ON h.sym = b.sym AND h.fold = b.fold AND h.spec = hs),
d AS (SELECT *, hs IS NOT NULL AND NOT hold AND NOT (alpha_pt >= 8 AND maxdd_pt <= 0 AND win_rate >= 0.48 AND score >= hscore + 5 AND (m2_pass OR stretch_hit AND sharpe_delta >= 0.05)) AS held FROM bb),
t AS (SELECT p.*, held FROM pool p JOIN d ON p.sym = d.sym AND p.fold = d.fold WHERE (held AND p.spec = hs) OR (NOT held AND p.score >= d.score - 15 AND p.alpha_pt >= d.alpha_pt - 5 AND p.sharpe_delta >= d.sharpe_delta - 0.2))"""

ORACLES = {
    "q_vol_target_grid": f"{_TESTED} SELECT {K}, bars, {_rounded(('total_return', 'max_dd', 'final_excess', 'maxdd_delta'), 5)} FROM x_s",
    "q_policy_family_summary": f"{_TESTED}, m AS (SELECT {K}, round(100 * final_excess, 5) AS a, round(100 * maxdd_delta, 5) AS d, round(turnover, 5) AS t FROM x_s JOIN x_st USING ({K})) SELECT spec, count(*) AS n, round(avg(a), 4) AS alpha_mean, round(quantile_cont(a, 0.5), 4) AS alpha_median, round(min(a), 4) AS alpha_worst, round(avg(d), 4) AS maxdd_mean, round(quantile_cont(d, 0.5), 4) AS maxdd_median, round(max(d), 4) AS maxdd_worst, count_if(d <= 0)::BIGINT AS dd_improved, round(avg(t), 4) AS turnover_mean FROM m GROUP BY spec",
    "q_selector_choice": f"{_CHOICE}, w AS (SELECT sym, fold, arg_min(spec, (CASE WHEN hold THEN 0 ELSE 1 END, turnover, maxdd_pt, -win_rate, -score, spec)) AS cand FROM t GROUP BY sym, fold) SELECT w.sym, w.fold, cand, round(score, 6) AS score, reject FROM w JOIN c0 ON c0.sym = w.sym AND c0.fold = w.fold AND c0.spec = cand",
    "q_execution_grid": f"{_CHOSEN} SELECT {K}, round(score, 5) AS score, bars, {_rounded(('total_return', 'final_excess', 'maxdd_delta'), 5)} FROM x_s JOIN best USING (sym, fold, spec)",
    "q_selector_candidates": f"{_CANDIDATES} SELECT {K}, hold, reject, m2_pass, stretch_hit, round(score, 6) AS score FROM cd",
    "q_policy_score": f"{_FIGURES}, p AS (SELECT *, CASE WHEN alpha_pt < 0 THEN 100 + 0.5 * abs(alpha_pt) ELSE 0 END + CASE WHEN NOT ok_collapse AND long_share >= 0.85 THEN 120 ELSE 0 END + CASE WHEN NOT ok_collapse AND short_share >= 0.85 THEN 120 ELSE 0 END + CASE WHEN avg_hold < 2 THEN 10 ELSE 0 END AS l, 2 * alpha_pt + 5 * sharpe_delta AS g FROM card) SELECT {K}, round(g - 5 * turnover - l - CASE WHEN NOT ok_collapse THEN 200 ELSE 0 END, 6) AS overlay_score, round(g - l - CASE WHEN flat_share >= 0.5 THEN 30 ELSE 0 END - CASE WHEN flat_share >= 0.8 THEN 100 ELSE 0 END - CASE WHEN NOT ok_collapse OR flat_share >= 0.8 THEN 200 ELSE 0 END - CASE WHEN switches = 0 THEN 25 ELSE 0 END, 6) AS plain_score FROM p",
    "q_selected_policy": f"""{_CHOICE}
SELECT sym, fold, 'conservative' AS mode, arg_min(spec, (CASE WHEN hold THEN 0 ELSE 1 END, turnover, maxdd_pt, -win_rate, -score, spec)) AS cand FROM t GROUP BY sym, fold
UNION ALL SELECT sym, fold, 'balanced', arg_min(spec, (-sharpe_delta, maxdd_pt, -win_rate, turnover, -score, spec)) FROM t GROUP BY sym, fold
UNION ALL SELECT sym, fold, 'score', arg_min(spec, (-score, -sharpe_delta, maxdd_pt, turnover, spec)) FROM t GROUP BY sym, fold""",
    "q_scorecard_totals": f"{_FIGURES}, g AS (SELECT spec, {', '.join(f'round(avg({c}), 5) AS {c}' for c in ('alpha_pt', 'sharpe_delta', 'maxdd_pt', 'win_rate'))}, {', '.join(f'bool_and({c}) AS {c}' for c in ('ok_alpha', 'ok_sharpe', 'ok_maxdd', 'ok_win_rate', 'ok_collapse'))}, bool_or(stretch_hit) AS stretch_hit, CASE WHEN bool_and(ok_collapse) THEN '' ELSE 'directional_collapse' END AS reasons FROM card GROUP BY spec) SELECT *, ok_alpha AND ok_sharpe AND ok_maxdd AND ok_win_rate AND ok_collapse AS m2_pass FROM g",
    "q_fold_table": f"{ROWS}, {FOLDS}, fr AS (SELECT r.*, fold FROM rows r JOIN folds f ON ts >= test_start AND ts <= test_end), {summary_sql('fr', 'sym, fold')} SELECT sym, fold, test_start, test_end, n_trades, {_rounded(('sharpe', 'sortino', 'max_dd', 'calmar', 'total_return'), 5)} FROM x_s JOIN folds USING (fold)",
    "q_component_attribution": f"{_FIRED}, c AS (SELECT *, (pos + 1) / 2 AS half FROM rows), d AS (SELECT sym, pos, base, half, {_NET.format(p='pos')} AS n, {_NET.format(p='base')} AS nb, {_NET.format(p='half')} AS nh FROM c), l AS (SELECT sym, 'no_adapter' AS variant, abs(pos - base) > 1e-6 AS o, n - nb AS g, n FROM d UNION ALL SELECT sym, 'half', abs(pos - half) > 1e-6, n - nh, n FROM d) SELECT sym, variant, count_if(o)::BIGINT AS active, round(avg(o::DOUBLE), 7) AS active_rate, round(coalesce(sum(g) FILTER (o), 0), 7) AS gain, round(coalesce(sum(n) FILTER (o), 0), 7) AS own FROM l GROUP BY ALL",
    "q_fire_dangers": f"{_DANGER} SELECT sym, ts, round(advantage, 7) AS advantage, round(post_dd, 7) AS post_dd, overlap, pre_dd FROM fdd",
    "q_fire_danger_summary": f"""{_DANGER}, lim AS (SELECT sym, quantile_cont(post_dd, 0.8) AS lim FROM fdd GROUP BY sym), mk AS (SELECT fdd.*, overlap OR pre_dd OR post_dd >= lim AS danger FROM fdd JOIN lim USING (sym)), ms AS (SELECT *, NOT danger AND advantage > 0 AS safe FROM mk), {summary_sql('rows', 'sym')},
tr AS (SELECT sym, arg_min(i, (dd, i)) AS trough FROM x_eq GROUP BY sym), pk AS (SELECT t.sym, trough, arg_max(i, (equity, -i)) AS peak FROM x_eq e JOIN tr t ON e.sym = t.sym AND e.i <= t.trough GROUP BY ALL), mj AS (SELECT ms.*, i >= pk.peak AND i <= pk.trough AS inside FROM ms JOIN pk USING (sym))
SELECT sym, count(*) AS fires, {', '.join(f'round(avg({c}::DOUBLE), 6) AS {n}' for c, n in (('danger', 'danger_rate'), ('pre_dd', 'pre_dd_rate'), ('overlap', 'overlap_rate'), ('inside', 'global_rate'), ('safe', 'safe_rate')))}, round(avg(advantage), 6) AS advantage, round(coalesce(avg(advantage) FILTER (safe), 0), 6) AS safe_advantage, round(avg(post_dd), 6) AS post_dd, round(coalesce(sum(p_on) FILTER (safe), 0), 6) AS safe_pnl, round(coalesce(sum(p_on) FILTER (danger), 0), 6) AS danger_pnl FROM mj GROUP BY sym""",
    "q_fire_candidates": f"""{_FIRED}, {summary_sql('rows', 'sym')}, w AS (SELECT *, sum(ret) OVER {_P} BETWEEN CURRENT ROW AND 7 FOLLOWING) AS fwd, pos - base AS delta, abs(pos - base) > 1e-6 AS fire FROM x_pnl),
o AS (SELECT sym, avg(fire::DOUBLE) AS fire_rate, count_if(fire)::BIGINT AS fires, coalesce(avg(delta) FILTER (fire), 0) AS mean_delta, coalesce(sum(pnl) FILTER (fire), 0) AS fire_pnl, coalesce(sum(pnl) FILTER (NOT fire), 0) AS other_pnl, coalesce(avg(fwd) FILTER (fire), 0) AS forward, coalesce(avg(delta * fwd) FILTER (fire), 0) AS incremental FROM w GROUP BY sym),
j AS (SELECT *, 100 * final_excess AS a, 100 * maxdd_delta AS d FROM o JOIN x_s USING (sym) JOIN x_st USING (sym)), k AS (SELECT *, CASE WHEN d > 0 THEN 'maxdd' WHEN a <= 0 THEN 'alpha' WHEN sharpe_delta < 0 THEN 'sharpe' WHEN fire_pnl <= 0 THEN 'fire_pnl' WHEN forward <= 0 THEN 'forward' WHEN incremental <= 0 THEN 'incremental' WHEN long_share > 0.03 THEN 'long' WHEN turnover > 3.5 THEN 'turnover' WHEN short_share > 0 THEN 'short' END AS reject FROM j)
SELECT sym, fires, {_rounded(('fire_rate', 'mean_delta', 'fire_pnl', 'other_pnl', 'forward', 'incremental'), 5)}, reject, round(a + 20 * sharpe_delta - 4 * greatest(d, 0) + 2 * greatest(-d, 0) + 30 * fire_pnl + 5000 * incremental + 1000 * forward - turnover - CASE WHEN reject IS NOT NULL THEN 1000 ELSE 0 END, 5) AS score FROM k""",
    "q_differential_sharpe": f"{_REC}, t AS MATERIALIZED (SELECT sym, ts, ret * 100 AS r, row_number() OVER {W} AS n FROM rows), d AS (SELECT DISTINCT sym, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS x FROM t UNION ALL SELECT t.sym, t.ts, t.n, d.a + 0.01 * (t.r - d.a), d.b + 0.01 * (t.r * t.r - d.b), (d.b * (t.r - d.a) - 0.5 * d.a * (t.r * t.r - d.b)) / pow(d.b - d.a * d.a + 1e-8, 1.5) FROM d JOIN t ON t.sym = d.sym AND t.n = d.n + 1) SELECT sym, ts, CASE WHEN abs(x) < 1e6 THEN round(x, 3) + 0.0 ELSE round(x / 1e4) * 1e4 END AS dsr FROM d WHERE n > 0",
    "q_rate_cap": f"{ROWS}, f AS (SELECT sym, ts, abs(ret) > 0.004 AS f, count(*) OVER (PARTITION BY sym) AS n FROM rows), g AS (SELECT *, sum(f::INT) OVER {_P} UNBOUNDED PRECEDING) AS c FROM f) SELECT sym, ts, (f AND c <= ceil(0.1 * n))::INT AS kept FROM g",
    "q_soft_executor": f"{_REC}, t AS MATERIALIZED (SELECT sym, ts, CASE WHEN ret > 0 THEN 1.1 ELSE 0.7 END::DOUBLE AS aim, least(abs(ret) * 100, 1) AS rate, row_number() OVER {W} AS n FROM rows), d AS (SELECT DISTINCT sym, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 1.0::DOUBLE AS p FROM t UNION ALL SELECT t.sym, t.ts, t.n, greatest(0.5, least(1.12, d.p + t.rate / (1 + exp(-50 * (abs(t.aim - d.p) - 0.05))) * greatest(-0.1, least(0.1, t.aim - d.p)))) FROM d JOIN t ON t.sym = d.sym AND t.n = d.n + 1) SELECT sym, ts, round(p, 6) AS position FROM d WHERE n > 0",
    "q_fingerprint": f"""WITH r AS (
  SELECT o_orderpriority AS p, epoch_us(o_orderdate) // {30 * 86_400_000_000} AS b, sha256({" || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("epoch_us(o_orderdate)::VARCHAR", "o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "o_totalprice::VARCHAR"))}) AS d FROM orders),
n AS (SELECT p, b, d, count(*) AS n FROM r GROUP BY ALL),
l AS (SELECT p, b, d[1:3] AS k, sum(n) AS n, sha256(string_agg(d || ':' || n, ',' ORDER BY d)) AS v FROM n GROUP BY ALL),
t AS (SELECT p, b, sum(n) AS n, sha256(string_agg(k || ':' || v, ',' ORDER BY k)) AS v FROM l GROUP BY ALL)
SELECT p AS o_orderpriority, sum(n)::BIGINT AS rows, sha256(string_agg(b || ':' || v, ',' ORDER BY b)) AS digest FROM t GROUP BY p""",
    "q_evenly_spaced": f"{ROWS}, i AS (SELECT sym, ts, ret, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY sym) AS m FROM rows) SELECT sym, ts, round(ret, 6) AS ret FROM i WHERE m <= 100 OR i IN (SELECT (k * (m - 1)) // 99 FROM range(100) t(k))",
    "q_running_best": f"WITH {_EPI}, e AS (SELECT user_id, chunk * 8 + step AS n, value FROM ep), b AS (SELECT user_id, n, max(value) OVER w AS best, arg_max(n, (value, -n)) OVER w AS bs FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, max((n - bs > 5)::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS late FROM b) SELECT user_id, n AS step, bs AS best_step, round(best, 6) AS best FROM l WHERE late = 0",
    "q_fold_coverage": f"{RETS}, {FOLDS}, {EXPANDED}, w AS (SELECT fold FROM fr GROUP BY fold HAVING count(DISTINCT role) = 3) SELECT fold, 'whole' AS state FROM w UNION ALL SELECT k::INT, 'missing' FROM (VALUES (0), (1), (2), (3), (9), (90)) v(k) WHERE k NOT IN (SELECT fold FROM w)",
    "q_support_lookup": f"{ROWS}, u AS (SELECT sym, ts, CASE WHEN abs(ret) > 0.005 THEN 1 ELSE 0 END AS g, CASE WHEN pos = 0.5 THEN 1 ELSE 2 END AS now, lead(CASE WHEN pos = 0.5 THEN 1 ELSE 2 END) OVER {W} AS nx FROM rows), c AS (SELECT g, now, nx, count(*) AS n FROM u WHERE nx IS NOT NULL GROUP BY ALL) SELECT sym, ts, coalesce(n, 0::BIGINT) AS support FROM u LEFT JOIN c ON u.g = c.g AND u.now = c.now AND u.nx = c.nx",
    "q_dsr_pvalue": f"{ROWS}, z AS (SELECT sym, ts, ret * 200 AS z, 1 / (1 + 0.2316419 * abs(ret * 200)) AS t FROM rows), p AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * pow(t, 2) + 1.781477937 * pow(t, 3) - 1.821255978 * pow(t, 4) + 1.330274429 * pow(t, 5)) AS a FROM z) SELECT sym, ts, round(CASE WHEN z >= 0 THEN a ELSE 1 - a END, 5) AS p FROM p",
    "q_reward_functionals": f"""{_EP}, u AS (SELECT *, ln(1 + greatest(n, -0.95)) AS g, ln(1 + greatest(b, -0.95)) AS h, -0.01 * o * o - 0.02 * greatest(-o, 0) - 0.03 * greatest(o, 0) - 0.001 * (o + 1) * (o + 1) - 0.002 * risk * (o + 1) * (o + 1) - 0.003 * risk * o + 0.004 * edge * o AS x FROM s),
v AS (SELECT *, sum(n) OVER {_Q} AS cn, sum(g) OVER {_Q} AS cg, sum(h) OVER {_Q} AS ch, sum(g - h) OVER {_Q} AS ce, count(*) OVER {_A} AS m FROM u),
d AS (SELECT *, max(cn) OVER {_Q} - cn AS d1, greatest(max(cg) OVER {_Q}, 0) - cg AS d2, max(cg) OVER {_Q} - cg - max(ch) OVER {_Q} + ch AS d3 FROM v),
e AS (SELECT *, {', '.join(f'last_value({c}) OVER (PARTITION BY user_id, chunk ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e{c}' for c in ('d1', 'd2', 'd3', 'cg', 'ce'))} FROM d)
SELECT user_id, chunk, round(sum((g - 0.1 * d1 - 0.5 * greatest(d1 - 0.001, 0) - 0.1 * ed1 - 0.4 * greatest(-n - 0.001, 0) - 0.2 * greatest(-n, 0)) / 2 + x), 8) AS budget,
 round(sum((g - 0.1 * d2 - 0.5 * greatest(d2 - 0.001, 0) - 0.1 * ed2 - 0.4 * greatest(-n - 0.001, 0) - 0.3 * greatest(0.002 - ecg, 0) / m - 0.2 * greatest(-n, 0)) / 2 + x), 8) AS relative,
 round(sum((g - h - 0.1 * d3 - 0.5 * greatest(d3 - 0.001, 0) + 0.2 * greatest(-d3 - 0.001, 0) - 0.1 * greatest(ed3 - 0.001, 0) + 0.05 * greatest(-ed3 - 0.001, 0) - 0.4 * greatest(h - g - 0.001, 0) - 0.3 * greatest(0.002 - ece, 0) / m - 0.2 * greatest(-n, 0)) / 2 + x), 8) AS absolute,
 round(sum(n / 2 - 0.3 * d1), 8) AS plain FROM e GROUP BY ALL""",
    "q_reward_scale": f"WITH RECURSIVE {_EPI}, q AS MATERIALIZED (SELECT user_id, (chunk * 8 + step) // 16 AS batch, quantile_cont(value / 7, 0.05) AS lo, quantile_cont(value / 7, 0.95) AS hi FROM ep GROUP BY ALL), r AS (SELECT user_id, batch, lo, hi FROM q WHERE batch = 0 UNION ALL SELECT q.user_id, q.batch, 0.99 * r.lo + 0.01 * q.lo, 0.99 * r.hi + 0.01 * q.hi FROM r JOIN q ON q.user_id = r.user_id AND q.batch = r.batch + 1) SELECT user_id, batch, round(lo, 6) AS low, round(hi, 6) AS high, round(greatest(1, hi - lo), 6) AS scale FROM r",
    "q_twohot_roundtrip": f"{ROWS}, u AS (SELECT sym, ts, greatest(-3, least(3, {_SYM.format(x='(ret * 300)')})) AS a FROM rows) SELECT sym, ts, round(sign(a) * (exp(abs(a)) - 1), 6) AS back FROM u",
    "q_masked_losses": f"""{ROWS}, u AS (SELECT sym, pos, lag(ret) OVER {W} * 300 AS p, ret * 300 AS t, (ret > 0)::DOUBLE AS up FROM rows), v AS (SELECT *, abs(p - t) AS d, ln(1 + exp(-abs(p))) AS s, CASE WHEN t = 0 THEN 0 WHEN t > 0 THEN p ELSE -p END AS hit FROM u)
SELECT sym, round(coalesce(avg(CASE WHEN d < 1 THEN 0.5 * d * d ELSE d - 0.5 END) FILTER (abs(t) > 0.1), 0), 6) AS l1, round(coalesce(avg(2 * up * (s + greatest(-p, 0)) + (1 - up) * (s + greatest(p, 0))) FILTER (p IS NOT NULL), 0), 6) AS bce, round(coalesce(avg(ln(1 + exp(p) + exp(-p)) - hit) FILTER (pos > 1 AND p IS NOT NULL), 0), 6) AS rank FROM v GROUP BY sym""",
}
