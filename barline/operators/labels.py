"""Forward-looking labels, teachers and transition advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.frames import SYM, ahead, clip, ordered, remaining, settled
from barline.operators.backtest import UNIT

ACTIONS = (0.0, 0.5, 1.0, 1.25)


def forward_stats(h: int, ret: str = "ret", by=SYM) -> tuple[Column, Column]:
    """Sum and population deviation of the next h returns, fewer at the end, 0 after it."""
    w = ahead(1, h, by)
    return F.coalesce(F.sum(ret).over(w), F.lit(0.0)), F.coalesce(F.stddev_pop(ret).over(w), F.lit(0.0))


def forward_sum(h: int, ret: str = "ret", by=SYM) -> Column:
    """Sum of this and the next h - 1 returns; null where there are fewer."""
    w = ahead(0, h - 1, by)
    return F.when(F.count(ret).over(w) == h, F.sum(ret).over(w))


def forward_vol(h: int, ret: str = "ret", by=SYM) -> Column:
    w = ahead(0, h - 1, by)
    return F.when(F.count(ret).over(w) == h, F.stddev_pop(ret).over(w) * h**0.5)


def path_drawdown(path: Column, scale: float = 1.0) -> Column:
    """Largest fall of a cumulative path below its peak, which starts at 0."""
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("p"), F.lit(0.0).alias("d"))

    def step(s, x):
        c = s["c"] + x * scale
        p = F.greatest(s["p"], c)
        return F.struct(c.alias("c"), p.alias("p"), F.greatest(s["d"], p - c).alias("d"))

    return F.aggregate(path, zero, step, lambda s: s["d"])


def forward_drawdown(h: int, ret: str = "ret", scale: float = 1.0, by=SYM) -> Column:
    w = ahead(0, h - 1, by)
    return F.when(F.count(ret).over(w) == h, path_drawdown(F.collect_list(ret).over(w), scale))


def signal_teacher(df: DataFrame, horizons=(4, 8, 16), weights=(1.0, 1.0, 1.0), downside: float = 0.5, downside_horizon: int = 8, bound: float = 4.0, dead: float = 0.1, scale: float = 1.0, bench: float = 1.0, low: float = 0.0, high: float = 1.0, by=SYM) -> DataFrame:
    """Risk-adjusted forward signal less the share of losses ahead; target below the benchmark when negative."""
    all_ = sum(weights)
    raw = None
    for h, w in zip(horizons, weights):
        total, dev = forward_stats(h, by=by)
        term = (w / all_) * total / (h**0.5 * (dev + 1e-6))
        raw = term if raw is None else raw + term
    window = ahead(1, downside_horizon, by)
    raw = raw - downside * F.coalesce(F.avg((F.col("ret") < 0).cast("double")).over(window), F.lit(0.0))
    out = df.withColumn("signal", clip(raw, -bound, bound))
    strength = 1 - F.exp(-F.greatest(F.lit(0.0), -(F.col("signal") + dead)) / scale)
    return out.withColumn("target", clip(bench - (bench - low) * strength, low, high))


def outcome_edge(df: DataFrame, pos: str, horizons=(4, 8), weights=(1.0, 1.0), bench: float = 1.0, by=SYM) -> DataFrame:
    """What a position gains over the benchmark on the weighted forward sums, if positive."""
    total = None
    for h, w in zip(horizons, weights):
        term = (w / sum(weights)) * forward_stats(h, by=by)[0]
        total = term if total is None else total + term
    return df.withColumn("edge", F.greatest(F.lit(0.0), (F.col(pos) - bench) * total))


def add_underweight_run(df: DataFrame, target: str = "target", bench: float = 1.0, by=SYM) -> DataFrame:
    """``future_run``: rows from this one on whose target stays below the benchmark."""
    row = F.row_number().over(ordered(by))
    out = df.withColumn("_n", row).withColumn("_stop", F.when(F.col(target) >= bench, F.col("_n")))
    end = F.coalesce(F.min("_stop").over(remaining(by)), F.max("_n").over(remaining(by)) + 1)
    return out.withColumn("future_run", (end - F.col("_n")).cast("double")).drop("_n", "_stop")


def triangular(x: Column, centres=(0.0, 0.5, 1.0)) -> Column:
    """Memberships in evenly spaced triangles, adding up to one; if all are 0, the nearest centre's is 1."""
    gap = centres[1] - centres[0]
    raw = F.array(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(x - c) / gap)) for c in centres))
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.array(*(F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]
    hot = F.array(*(F.when(near == i, 1.0).otherwise(0.0) for i in range(len(centres))))
    return F.when(total > 0, F.transform(raw, lambda v: v / total)).otherwise(hot)


def stress_target(df: DataFrame, terms: dict[str, tuple[float, float, float]], bench: float = 1.0, low: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Weighted hinges of features, as strength of a target below the benchmark.

    ``terms``: feature -> (weight, centre, sign).  A missing feature counts as 0.
    """
    total = F.lit(0.0)
    for name, (weight, centre, sign) in terms.items():
        x = F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)
        total = total + weight * F.greatest(F.lit(0.0), sign * x - centre)
    out = df.withColumn("stress", total)
    return out.withColumn("target", clip(bench - (bench - low) * (1 - F.exp(-F.col("stress") / scale)), low, bench))


def transition_class(current: Column, target: Column, bench: float = 1.0, eps: float = 1e-6) -> Column:
    """What a move from ``current`` to ``target`` is, against the benchmark."""
    under = current < bench - eps
    return (
        F.when(target > bench + eps, "overweight")
        .when(target < bench - eps, F.when(under, "stay_underweight").otherwise("de_risk"))
        .otherwise(F.when(under, "recovery").otherwise("neutral"))
    )


#: Route of each transition class.
ROUTES = {"neutral": 0, "de_risk": 1, "stay_underweight": 1, "recovery": 2, "overweight": 3}


def route(name: Column) -> Column:
    out = F.when(name == "neutral", 0)
    for k, v in list(ROUTES.items())[1:]:
        out = out.when(name == k, v)
    return out


def nearest(x: Column, actions=ACTIONS) -> Column:
    """Place of the nearest action, the first on ties."""
    return F.array_min(F.array(*(F.struct(F.abs(x - a).alias("d"), F.lit(i).alias("i")) for i, a in enumerate(actions))))["i"]


def first_best(values: Column) -> Column:
    """Place of the largest value, the first on ties; nulls last."""
    best = F.array_max(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), lambda s: s["v"].isNotNull()))
    return -best["i"]


def transition_values(df: DataFrame, horizons=(4, 8), weights=None, actions=ACTIONS, bench: float = 1.0, unit: float = UNIT, turnover: float = 0.0, vol: float = 0.1, drawdown: float = 0.2, leverage: float = 0.0, short: float = 0.0, by=SYM) -> DataFrame:
    """(…, values): for each action the mean (by ``weights``), over the horizons that are whole, of its gain over the benchmark less penalties.

    Drawdowns of ``k * path`` are ``|k|`` times those of the path with k's sign,
    so two for each horizon are enough.
    """
    made, share = {}, tuple(map(float, weights or (1,) * len(horizons)))
    for h in horizons:
        made |= {f"_s{h}": forward_sum(h, by=by), f"_v{h}": forward_vol(h, by=by), f"_u{h}": forward_drawdown(h, scale=1.0, by=by), f"_d{h}": forward_drawdown(h, scale=-1.0, by=by)}
    out = df.withColumns(made)
    each = []
    for a in actions:
        over = a - bench
        delta = F.abs(a - F.col("pos"))
        terms = []
        for h in horizons:
            fall = F.col(f"_u{h}") if over > 0 else F.col(f"_d{h}")
            terms.append(over * F.col(f"_s{h}") - (unit + turnover) * delta - vol * F.col(f"_v{h}") * abs(over) - drawdown * abs(over) * fall - leverage * max(over, 0.0) * h - short * max(-a, 0.0) * h)
        have = sum((F.when(t.isNotNull(), w).otherwise(0.0) for t, w in zip(terms, share)), F.lit(0.0))
        each.append(F.try_divide(sum((w * F.coalesce(t, F.lit(0.0)) for t, w in zip(terms, share)), F.lit(0.0)), have))
    return settled(out.withColumn("values", F.array(*each)).drop(*made))


def transition_advantage(df: DataFrame, margin: float = 0.0, actions=ACTIONS, bench: float = 1.0, by=SYM, **penalties) -> DataFrame:
    """Adds best action, value and advantage; the benchmark where no action gains more than ``margin``."""
    out = transition_values(df, actions=actions, bench=bench, by=by, **penalties)
    neutral = min(range(len(actions)), key=lambda i: abs(actions[i] - bench))
    at = lambda i: F.element_at("values", i + 1)
    out = out.withColumn("_best", first_best(F.col("values")))
    value, base, now = at(F.col("_best")), at(F.lit(neutral)), at(nearest(F.col("pos"), actions))
    gain = F.greatest(value - base, value - now, F.lit(0.0))
    hold = value.isNull() | (gain <= margin)
    table = F.array(*map(F.lit, actions))
    return out.withColumns({
        "best_idx": F.when(hold, neutral).otherwise(F.col("_best")), "best_advantage": F.when(hold, 0.0).otherwise(gain),
        "best_value": F.when(hold, base).otherwise(value), "best_target": F.when(hold, bench).otherwise(F.element_at(table, F.col("_best") + 1)),
    }).withColumn("best_class", transition_class(F.col("pos"), F.col("best_target"), bench)).drop("_best")


def future_returns(h: int, offset: int, ret: str = "ret", by=SYM) -> Column:
    w = ahead(offset, offset + h - 1, by)
    return F.when(F.count(ret).over(w) == h, F.sum(ret).over(w))


def path_windows(df: DataFrame, columns: tuple[str, ...], h: int, state: str = "pos", by=SYM) -> DataFrame:
    """Each bar that ``h`` bars begin with: arrays ``NAME_path`` of the columns over these, and the ``start`` state.

    Nulls keep their places.  The last bars of a group, which have fewer ahead, begin no window.
    """
    w = ahead(0, h - 1, by)
    # lists drop nulls, structs around them don't
    paths = {f"{c}_path": F.transform(F.collect_list(F.struct(F.col(c).alias("x"))).over(w), lambda s: s["x"]) for c in columns}
    return df.withColumns({**paths, "start": F.col(state), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") == h).drop("_n")


def future_risk(df: DataFrame, h: int, crash: float, excess: float = 0.0, ret: str = "ret", by=SYM) -> DataFrame:
    """RMS volatility, depth below the start, crash flag, and depth beyond ``excess``, of the next h bars."""
    w = ahead(1, h, by)
    whole = F.count(ret).over(w) == h
    path = F.collect_list(ret).over(w)
    low = F.aggregate(path, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("m")), lambda s, x: F.struct((s["c"] + x).alias("c"), F.least(s["m"], s["c"] + x).alias("m")), lambda s: -s["m"])
    out = df.withColumns({f"vol_{h}": F.when(whole, F.sqrt(F.avg(F.col(ret) * F.col(ret)).over(w))), f"depth_{h}": F.when(whole, low)})
    known = F.col(f"depth_{h}").isNotNull()
    return out.withColumns({f"crash_{h}": F.when(known, (F.col(f"depth_{h}") >= crash).cast("int")), f"excess_{h}": F.when(known, F.greatest(F.col(f"depth_{h}") - excess, F.lit(0.0)))})


def position_utility(df: DataFrame, h: int, actions=ACTIONS, bench: float = 1.0, unit: float = UNIT, dd: float = 0.5, vol: float = 0.1, by=SYM) -> DataFrame:
    """(sym, ts, action, utility) for each candidate position over the next h bars."""
    w = ahead(1, h, by)
    base = df.withColumns({"_sum": future_returns(h, 1, by=by), "_path": F.collect_list("ret").over(w), "_vol": F.stddev_pop("ret").over(w)}).where("_sum is not null")
    long = base.withColumn("action", F.explode(F.array(*map(F.lit, actions))))
    low = lambda k: F.aggregate("_path", F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("m")), lambda s, x: F.struct((s["c"] + x * k).alias("c"), F.least(s["m"], s["c"] + x * k).alias("m")), lambda s: -s["m"])
    over = F.col("action") - bench
    change = low(F.col("action")) - low(F.lit(bench))
    value = over * F.col("_sum") - unit * F.abs(F.col("action") - F.col("pos")) - dd * change - vol * F.abs(over) * F.col("_vol")
    return long.select(*by, "ts", "action", value.alias("utility"))


def future_control(df: DataFrame, h: int, delta: float = 0.1, unit: float = UNIT, dd: float = 1.0, recovery_dd: float = 1.0, scale: float = 1.0, ret: str = "ret", by=SYM) -> DataFrame:
    """``overweight_h``: what a small overweight gains over the next h bars, less drawdown and cost; ``recovery_h``: their
    return less drawdown in deviations, bounded to [-1, 1]."""
    w = ahead(1, h, by)
    whole, x = F.count(ret).over(w) == h, F.col(ret)
    low = F.aggregate(F.collect_list(ret).over(w), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("m")), lambda s, v: F.struct((s["c"] + v).alias("c"), F.least(s["m"], s["c"] + v).alias("m")), lambda s: -s["m"])
    total, vol = F.sum(ret).over(w), F.sqrt(F.sum(x * x).over(w) / h + 1e-12)
    gain = (delta * total - delta * dd * low - unit * abs(delta)) * scale
    back = clip((total - recovery_dd * low) / (vol * h**0.5 + 1e-6), -5.0, 5.0) / 5.0
    return df.withColumns({f"overweight_{h}": F.when(whole, gain), f"recovery_{h}": F.when(whole, back)})


def utility_allocator(utility: Column, actions=ACTIONS) -> Column:
    """The action with the largest utility, the first on ties."""
    return F.element_at(F.array(*map(F.lit, actions)), first_best(utility) + 1)
