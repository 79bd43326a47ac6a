"""Evaluation of policies: candidates and their scores, execution grids, fold tables, fires and their dangers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.frames import SYM, ahead, ordered, run_ids
from barline.operators import backtest, diagnostics, selection
from barline.operators.backtest import UNIT
from barline.operators.quantiles import quantiles

#: Limits and weights of candidates for selection.
SELECTOR = {
    "alpha_floor": -25.0, "sharpe_floor": -1.0, "maxdd_worse": 5.0, "win_floor": 0.35, "max_turnover": 8.0, "max_long": 1.0, "max_short": 1.0,
    "hard_maxdd": float("inf"), "min_hold": 3.0, "max_directional": 1.01, "directional_soft": 0.9, "directional": 80.0, "turnover": 3.0,
    "turnover_target": 8.0, "turnover_excess": 0.0, "maxdd": 50.0, "maxdd_worse_weight": 1.5, "maxdd_better_weight": 0.5, "win": 20.0, "alpha": 2.0,
    "sharpe": 5.0, "period_bonus": 0.0, "m2": 15.0, "stretch": 5.0,
}


def figures(rows: DataFrame, period: int, by=SYM) -> DataFrame:
    """What selection looks at, for each group: alpha and drawdown in points, Sharpe gain, win rate and action shares."""
    m = backtest.summary(rows, by).join(backtest.action_stats(rows, by=by), list(by)).join(backtest.period_win_rate(rows, period, by), list(by))
    out = m.withColumns({"alpha_pt": 100 * F.col("final_excess"), "maxdd_pt": 100 * F.col("maxdd_delta")})
    return out.select(*by, "alpha_pt", "sharpe_delta", F.abs("max_dd").alias("depth"), "maxdd_pt", "win_rate", "long_share", "short_share", "flat_share", "turnover", "switches", "avg_hold")


def collapsed(long: Column, short: Column) -> Column:
    """One side for most bars, hardly a switch and little turnover."""
    return (F.greatest(long, short) >= 0.8) & (F.col("switches") <= 5) & (F.col("turnover") < 1)


def candidates(metrics: DataFrame, bench: float = 1.0, **limits: float) -> DataFrame:
    """``metrics`` (see ``figures``) with hold, reject, score, m2_pass and stretch_hit of each row.

    The first rule that a candidate breaks is its ``reject`` reason; holding the
    benchmark breaks none.
    """
    k, c = SELECTOR | limits, F.col
    overlay = abs(bench) > 1e-8
    card = selection.scorecard(metrics)
    side = F.greatest("long_share", "short_share")
    hold = F.lit(overlay) & (c("flat_share") >= 0.95) & (c("switches") == 0)
    rules = [
        ("alpha", c("alpha_pt") <= k["alpha_floor"]), ("sharpe", c("sharpe_delta") <= k["sharpe_floor"]), ("maxdd", c("maxdd_pt") > k["maxdd_worse"]),
        ("win", c("win_rate") < k["win_floor"]), ("turnover", c("turnover") > k["max_turnover"]), ("long", c("long_share") > k["max_long"]),
        ("short", c("short_share") > k["max_short"]), ("hard_maxdd", c("maxdd_pt") > k["hard_maxdd"]), ("avg_hold", c("avg_hold") < k["min_hold"]),
        ("collapse", collapsed(c("long_share"), c("short_share"))), ("one_sided", side >= k["max_directional"]), ("flat", F.lit(not overlay) & (c("flat_share") >= 0.8)),
    ]
    plus = lambda x: F.greatest(x, F.lit(0.0))
    score = (
        k["alpha"] * c("alpha_pt") + k["sharpe"] * c("sharpe_delta") - k["turnover"] * c("turnover") - k["turnover_excess"] * plus(c("turnover") - k["turnover_target"])
        - k["maxdd"] * c("depth") - k["maxdd_worse_weight"] * plus(c("maxdd_pt")) + k["maxdd_better_weight"] * plus(-c("maxdd_pt"))
        + k["win"] * (c("win_rate") - 0.5) + k["period_bonus"] * plus(c("win_rate") - 0.5) - F.when(c("hold"), 0.0).otherwise(k["directional"] * plus(side - k["directional_soft"]))
        + F.when(c("m2_pass"), k["m2"]).when(c("stretch_hit"), k["stretch"]).otherwise(0.0) + F.when(c("hold"), 0.5).otherwise(0.0) - F.when(c("reject").isNotNull(), 500.0).otherwise(0.0)
    )
    out = card.withColumn("hold", hold).withColumn("reject", F.when(~hold, selection.reject_reason(rules)))
    return out.withColumn("score", score)


def policy_score(bench: float = 1.0) -> Column:
    """One number for a checkpoint, from the columns of ``figures``."""
    c, overlay = F.col, abs(bench) > 1e-8
    stuck, flat = collapsed(c("long_share"), c("short_share")), F.lit(not overlay) & (c("flat_share") >= 0.8)
    when = lambda cond, x: F.when(cond, x).otherwise(0.0)
    loss = (
        when(c("alpha_pt") < 0, 100.0 + 0.5 * F.abs("alpha_pt")) + when(F.lit(not overlay) & (c("flat_share") >= 0.5), 30.0) + when(flat, 100.0)
        + when(stuck & (c("long_share") >= 0.85), 120.0) + when(stuck & (c("short_share") >= 0.85), 120.0) + when(stuck | flat, 200.0)
        + when(c("avg_hold") < 2, 10.0) + when(F.lit(not overlay) & (c("switches") == 0), 25.0)
    )
    return 2 * c("alpha_pt") + 5 * c("sharpe_delta") - (5 * c("turnover") if overlay else 0.0) - loss


def best_spec(metrics: DataFrame, by, spec: str = "spec") -> DataFrame:
    """(by, spec, score): the setting with the best validation score of each group, the first on ties."""
    scored = metrics.withColumn("score", F.round(selection.validation_score(F.col("alpha_pt"), F.col("maxdd_pt"), F.col("turnover")), 9))
    best = F.max(F.struct("score", (-F.col(spec)).alias("k")))
    return scored.groupBy(*by).agg(best.alias("_b")).select(*by, (-F.col("_b.k")).alias(spec), F.col("_b.score").alias("score"))


def fold_table(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """One row for each symbol and fold of a walk-forward run: test span and the main figures."""
    m = backtest.full(rows, ("sym", "fold"))
    return m.join(F.broadcast(folds.select("fold", "test_start", "test_end")), "fold").select("sym", "fold", "test_start", "test_end", "sharpe", "sortino", "max_dd", "calmar", "total_return", "n_trades")


def aggregate_scorecards(cards: DataFrame, by=()) -> DataFrame:
    """Means of the figures, whether all rows pass each goal, whether any reaches a stretch goal, and all collapse reasons."""
    goals = ("ok_alpha", "ok_sharpe", "ok_maxdd", "ok_win_rate", "ok_collapse")
    out = cards.groupBy(*by).agg(
        *(F.avg(c).alias(c) for c in ("alpha_pt", "sharpe_delta", "maxdd_pt", "win_rate")), *(F.bool_and(g).alias(g) for g in goals), F.bool_or("stretch_hit").alias("stretch_hit"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok_collapse"), "directional_collapse"))), ",").alias("reasons"),
    )
    both = F.lit(True)
    for g in goals:
        both = both & F.col(g)
    return out.withColumn("m2_pass", both)


def component_attribution(rows: DataFrame, variants: dict[str, str], unit: float = UNIT, by=SYM) -> DataFrame:
    """(by, variant, active, active_rate, gain, own): where the path differs from each variant, its net gain over that and its own net."""
    net = lambda p: F.col(p) * F.col("ret") - unit * F.abs(F.col(p) - F.lag(p, 1, 0.0).over(ordered(by)))
    df = rows.withColumns({"_net": net("pos")} | {f"_net_{k}": net(c) for k, c in variants.items()})
    each = F.array(*(F.struct(F.lit(k).alias("variant"), (F.abs(F.col("pos") - F.col(c)) > 1e-6).alias("on"), (F.col("_net") - F.col(f"_net_{k}")).alias("gain")) for k, c in variants.items()))
    long = df.select(*by, "_net", F.explode(each).alias("v"))
    return long.groupBy(*by, F.col("v.variant").alias("variant")).agg(
        F.count_if("v.on").alias("active"), F.avg(F.col("v.on").cast("double")).alias("active_rate"),
        F.coalesce(F.sum(F.when(F.col("v.on"), F.col("v.gain"))), F.lit(0.0)).alias("gain"), F.coalesce(F.sum(F.when(F.col("v.on"), F.col("_net"))), F.lit(0.0)).alias("own"),
    )


def _depths(pnl: Column) -> Column:
    """Of a path of log returns: places of the first deepest trough and of its peak (from 0), and the depths along it."""
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("top"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0.0).alias("worst"), F.lit(0).alias("peak"), F.array().cast("array<double>").alias("path"))

    def step(s, x):
        c = s["c"] + x
        new = s["top"].isNull() | (c > s["top"])
        top, at = F.when(new, c).otherwise(s["top"]), F.when(new, s["i"]).otherwise(s["at"])
        depth = 1 - F.exp(c - top)
        deeper = depth > s["worst"]
        return F.struct(
            c.alias("c"), top.alias("top"), at.alias("at"), (s["i"] + 1).alias("i"), F.greatest(s["worst"], depth).alias("worst"),
            F.when(deeper, at).otherwise(s["peak"]).alias("peak"), F.concat(s["path"], F.array(depth)).alias("path"),
        )

    return F.aggregate(pnl, zero, step, lambda s: F.struct(s["worst"].alias("worst"), s["peak"].alias("peak"), s["path"].alias("path")))


def fire_dangers(rows: DataFrame, horizon: int = 32, vol_window: int = 64, threshold: float = 0.5, unit: float = UNIT, by=SYM) -> DataFrame:
    """One row for each fire (``pos`` away from ``base``) with ``horizon`` bars ahead: what it gains there over the base path,
    by how much it deepens the drawdown, and whether a deep drawdown begins in its run (overlap) or soon after (pre_dd)."""
    n = F.row_number().over(ordered(by)) - 1
    cost = lambda p: unit * F.abs(F.col(p) - F.lag(p, 1, 0.0).over(ordered(by)))
    df = rows.withColumns({"i": n, "fire": F.abs(F.col("pos") - F.col("base")) > 1e-6, "on": F.col("pos") * F.col("ret") - cost("pos"), "off": F.col("base") * F.col("ret") - cost("base")})
    df = df.withColumn("was", F.lag("fire").over(ordered(by)))
    df = run_ids(df, F.col("fire") != F.col("was"), "_run", by)
    df = df.withColumn("run_end", F.max("i").over(ordered((*by, "_run")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1)
    w = ahead(0, horizon - 1, by)
    df = df.withColumns({"_on": F.collect_list("on").over(w), "_off": F.collect_list("off").over(w), "vol": F.coalesce(F.stddev_pop("ret").over(ahead(-vol_window, -1, by)), F.lit(0.0))})
    df = df.where(F.col("fire") & (F.size("_on") == horizon))
    df = df.withColumns({"_d": _depths(F.col("_on")), "_e": _depths(F.col("_off"))})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    stop = F.greatest(F.lit(0), F.least(F.lit(horizon - 1), F.col("run_end") - F.col("i") - 1))
    deep = F.col("_d.worst") > threshold * F.greatest(F.col("vol") * horizon**0.5, F.lit(1e-8))
    return df.withColumns({
        "advantage": total("_on") - total("_off"), "post_dd": F.greatest(F.lit(0.0), F.array_max(F.zip_with("_d.path", "_e.path", lambda x, y: x - y))),
        "overlap": deep & (F.col("_d.peak") <= stop), "pre_dd": deep & (F.col("_d.peak") > stop) & (F.col("_d.peak") <= F.greatest(stop + 1, F.lit(horizon // 2))),
    }).select(*by, "ts", "i", "on", "advantage", "post_dd", "overlap", "pre_dd")


def danger_summary(rows: DataFrame, quantile: float = 0.8, include_post_dd: bool = True, by=SYM, **options) -> DataFrame:
    """Rates of dangerous and safe fires of each group, their mean gains and their net."""
    fires = fire_dangers(rows, by=by, **options)
    limit = quantiles(fires, "post_dd", (quantile,), by).select(*by, F.col("_q")[0].alias("_limit"))
    high = (F.col("post_dd") >= F.col("_limit")) if include_post_dd else F.lit(False)
    marked = fires.join(limit, list(by)).withColumn("danger", F.col("overlap") | F.col("pre_dd") | high).withColumn("safe", ~F.col("danger") & (F.col("advantage") > 0))
    drop = diagnostics.maxdd_interval(rows, by).select(*by, "peak", "trough")
    marked = marked.join(drop, list(by), "left").withColumn("inside", F.coalesce((F.col("i") >= F.col("peak")) & (F.col("i") <= F.col("trough")), F.lit(False)))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    net = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("on"))), F.lit(0.0))
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fires"), rate("danger").alias("danger_rate"), rate("pre_dd").alias("pre_dd_rate"), rate("overlap").alias("overlap_rate"), rate("inside").alias("global_rate"),
        rate("safe").alias("safe_rate"), F.avg("advantage").alias("advantage"), F.coalesce(F.avg(F.when(F.col("safe"), F.col("advantage"))), F.lit(0.0)).alias("safe_advantage"),
        F.avg("post_dd").alias("post_dd"), net("safe").alias("safe_pnl"), net("danger").alias("danger_pnl"),
    )


#: Limits of adapters that fire.
FIRES = {"maxdd": 0.0, "alpha": 0.0, "sharpe": 0.0, "fire_pnl": 0.0, "forward": 0.0, "incremental": 0.0, "long": 0.03, "turnover": 3.5, "short": 0.0}


def fire_candidates(rows: DataFrame, horizon: int = 16, by=SYM, **limits: float) -> DataFrame:
    """(by, figures, reject, score) of an adapted path (``pos``) against its base path (``base``), by what it does where they differ."""
    k, c = FIRES | limits, F.col
    df = backtest.with_pnl(rows, by=by).withColumns({"delta": c("pos") - c("base"), "fire": F.abs(c("pos") - c("base")) > 1e-6, "fwd": F.sum("ret").over(ahead(0, horizon - 1, by))})
    hit = lambda x: F.when(c("fire"), x)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    own = df.groupBy(*by).agg(
        F.avg(c("fire").cast("double")).alias("fire_rate"), F.count_if("fire").alias("fires"), zero(F.avg(hit(c("delta")))).alias("mean_delta"), zero(F.sum(hit(c("pnl")))).alias("fire_pnl"),
        zero(F.sum(F.when(~c("fire"), c("pnl")))).alias("other_pnl"), zero(F.avg(hit(c("fwd")))).alias("forward"), zero(F.avg(hit(c("delta") * c("fwd")))).alias("incremental"),
    )
    m = figures(rows, 21, by).join(own, list(by))
    rules = [
        ("maxdd", c("maxdd_pt") > k["maxdd"]), ("alpha", c("alpha_pt") <= k["alpha"]), ("sharpe", c("sharpe_delta") < k["sharpe"]), ("fire_pnl", c("fire_pnl") <= k["fire_pnl"]),
        ("forward", c("forward") <= k["forward"]), ("incremental", c("incremental") <= k["incremental"]), ("long", c("long_share") > k["long"]), ("turnover", c("turnover") > k["turnover"]), ("short", c("short_share") > k["short"]),
    ]
    plus = lambda x: F.greatest(x, F.lit(0.0))
    score = c("alpha_pt") + 20 * c("sharpe_delta") - 4 * plus(c("maxdd_pt")) + 2 * plus(-c("maxdd_pt")) + 30 * c("fire_pnl") + 5000 * c("incremental") + 1000 * c("forward") - c("turnover")
    out = m.withColumn("reject", selection.reject_reason(rules))
    return out.withColumn("score", score - F.when(c("reject").isNotNull(), 1000.0).otherwise(0.0)).select(*by, "fires", "fire_rate", "mean_delta", "fire_pnl", "other_pnl", "forward", "incremental", "reject", "score")


def fingerprint(df: DataFrame, by=(), ts: str = "ts", width: int = 30 * 86_400_000_000) -> DataFrame:
    """(by, rows, digest): a tree of SHA-256 digests over rows in the order of their time.

    A row's digest is of its fields with their lengths, nulls marked, so that no
    text can stand for two fields.  Rows of a time bucket are split by the first
    digits of their digests; a leaf is the digest of its sorted row digests with
    how often each occurs, a bucket's of its leaves, a group's of its buckets in
    order.  Any change of a value, a time, a repeat or a column's place shows;
    partitions don't.  Each list is as long as a leaf, the leaves of a bucket,
    or the buckets of the whole time.
    """
    text = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("string") if kinds[c].startswith("timestamp") else F.col(c).cast("string")
    kinds = dict(df.dtypes)
    fields = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in df.columns if c not in by]
    time = F.unix_micros(F.col(ts).cast("timestamp")) if kinds[ts].startswith("timestamp") else F.col(ts)
    rows = df.select(*by, F.floor(time / width).alias("_bucket"), F.sha2(F.concat(*fields), 256).alias("_row"))
    counted = rows.groupBy(*by, "_bucket", "_row").agg(F.count(F.lit(1)).alias("_n"))

    def above(below: DataFrame, keys: tuple, *line: Column) -> DataFrame:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*line))), lambda s: F.concat_ws(":", s["k"], s["v"])), ",")
        return below.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sha2(joined, 256).alias("_digest"))

    leaf = F.substring("_row", 1, 3).alias("_leaf")
    leaves = above(counted.withColumn("_leaf", leaf), (*by, "_bucket", "_leaf"), F.col("_row").alias("k"), F.col("_n").cast("string").alias("v"))
    buckets = above(leaves, (*by, "_bucket"), F.col("_leaf").alias("k"), F.col("_digest").alias("v"))
    return above(buckets, by, F.col("_bucket").alias("k"), F.col("_digest").alias("v")).select(*by, F.col("_n").alias("rows"), F.col("_digest").alias("digest"))


def evenly_spaced(df: DataFrame, n: int, by=SYM) -> DataFrame:
    """``n`` rows of each group, evenly spaced in time order from the first to the last; all rows if fewer."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    row = df.withColumn("_i", F.row_number().over(ordered(by)) - 1).join(size, list(by))
    # the k-th place is floor(k (m - 1) / (n - 1)): a row is taken if some k gives its place
    k = F.ceil(F.col("_i") * (n - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))
    taken = (F.col("_m") <= n) | (F.floor(k * (F.col("_m") - 1) / (n - 1)) == F.col("_i"))
    return row.where(taken).drop("_i", "_m")


def distinct_values(df: DataFrame, value: str, by=SYM, order: str = "ts", sort: bool = False) -> DataFrame:
    """(by, values): each group's distinct values, in the order in which they first come up, or sorted; nulls left out."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_first"))
    key = F.struct(F.col(value).alias("v")) if sort else F.struct("_first", F.col(value).alias("v"))
    return firsts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["v"]).alias("values"))


def running_best(df: DataFrame, score: str, patience: int, by=SYM) -> DataFrame:
    """Steps up to the stop (no new best for ``patience`` steps), each with the best step so far."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("step")).alias("k"))).over(ordered(by, "step").rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_b", best).withColumn("best_step", -F.col("_b.k")).withColumn("best", F.col("_b.s"))
    late = F.max(F.when(F.col("step") - F.col("best_step") > patience, 1).otherwise(0)).over(ordered(by, "step").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_late", late).where("_late = 0").drop("_b", "_late")
