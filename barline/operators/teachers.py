"""Teacher paths and soft labels: trailing state, overlays, routes, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.frames import SYM, ahead, clip, ordered, running, settled, trailing
from barline.functions import scalar
from barline.operators import chunks, scans
from barline.operators.quantiles import quantiles, with_quantiles
from barline.operators.labels import ACTIONS, ROUTES, UNIT, first_best, nearest, route, transition_class, transition_values


def add_trailing_state(df: DataFrame, trend: int, depth: int, vol: int, ret: str = "ret", by=SYM) -> DataFrame:
    """``trend``, ``depth`` and ``past_vol``: what is known before each bar of its
    trailing sum, its drawdown within a window, and the deviation of past returns."""
    late = df.withColumn("_late", F.coalesce(F.lag(ret).over(ordered(by)), F.lit(0.0)))
    late = late.withColumn("_path", F.sum("_late").over(running(by)))
    return late.withColumns({
        "trend": F.sum("_late").over(trailing(trend, by)), "depth": F.max("_path").over(trailing(depth, by)) - F.col("_path"),
        "past_vol": F.coalesce(F.stddev_pop(ret).over(ahead(-vol, -1, by)), F.lit(0.0)),
    }).drop("_late", "_path")


def smoothed(df: DataFrame, names: tuple[str, ...], span: int, by=SYM) -> DataFrame:
    """``NAME_slow``: exponential means of the columns, in one pass."""
    return chunks.ema(df, names, scans.span(span), tuple(f"{n}_slow" for n in names), by)


#: Limits and sizes of the low-frequency overlay.
LOW_FREQUENCY = {"risk_hi": 1.0, "risk_lo": 0.0, "trend_max": 0.0, "trend_min": 0.0, "edge_hi": 0.0, "edge_lo": 0.0, "depth_min": 0.0, "depth_max": float("inf"), "base": 0.0, "down": 0.04, "up": 0.0}


def low_frequency_overlay(df: DataFrame, hold: int = 0, dead: float = 0.0, safe_base: bool = False, by=SYM, **limits: float) -> DataFrame:
    """``overlay`` from ``risk_slow``, ``edge_slow``, ``trend`` and ``depth``: below the base where risk is high in a
    bad trend, above it where risk is low in a good one, and held for ``hold`` bars."""
    k = LOW_FREQUENCY | limits
    risk, edge, trend, depth = (F.col(c) for c in ("risk_slow", "edge_slow", "trend", "depth"))
    down = (risk >= k["risk_hi"]) & (trend <= k["trend_max"]) & (depth >= k["depth_min"]) & (edge <= k["edge_lo"])
    up = (risk <= k["risk_lo"]) & (trend >= k["trend_min"]) & (depth <= k["depth_max"]) & (edge >= k["edge_hi"])
    base = F.when((trend >= k["trend_min"]) & (depth <= k["depth_max"]), k["base"]).otherwise(0.0) if safe_base else F.lit(k["base"])
    out = df.withColumn("_raw", F.when(up, k["base"] + abs(k["up"])).when(down, k["base"] - abs(k["down"])).otherwise(base))
    if hold < 1:
        return out.withColumnRenamed("_raw", "overlay")
    return chunks.regime_hold(out, hold, dead, "_raw", "overlay", by=by).drop("_raw")


def affine_overlay(base: float, risk: float, edge: float, utility: float, trend_down: float, trend_up: float, centre: float = 0.0, gate: float = 3.0) -> Column:
    """A continuous overlay of ``risk_slow``, ``edge_slow``, ``utility`` and ``trend``; risk weighs only where the edge is weak."""
    weak = scalar.sigmoid(-clip(F.col("edge_slow") * gate, -30, 30))
    excess = F.greatest(F.col("risk_slow") - centre, F.lit(0.0))
    return (
        base + edge * F.col("edge_slow") + utility * F.col("utility") + trend_up * F.greatest(F.col("trend"), F.lit(0.0))
        - risk * excess * weak - trend_down * F.greatest(-F.col("trend"), F.lit(0.0))
    )


def vector_signal(vector: Column, indices: tuple[int, ...]) -> Column:
    """Mean of the elements at ``indices`` (from 0) that the vector has; 0 without one, or where it is no finite number."""
    there = F.filter(F.array(*(F.when(F.size(vector) > i, F.struct(F.get(vector, F.lit(i)).cast("double").alias("x"))) for i in indices if i >= 0)), lambda e: e.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, e: s + e["x"]), F.size(there))
    return F.when((F.size(there) > 0) & mean.isNotNull() & ~F.isnan(mean) & (F.abs(mean) < float("inf")), mean).otherwise(0.0)


def risk_gate(signal: Column, centre: float = 0.0, scale: float = 1.0, least: float = 0.0) -> Column:
    """Share, ``least`` to 1, that rises with a signal about its centre."""
    return least + (1 - least) * scalar.sigmoid(clip((signal - centre) * scale, -30, 30))


def risk_state(vector: Column, indices: tuple[int, ...], centre: float = 0.0, scale: float = 1.0) -> Column:
    """How far the mean of chosen elements lies above its centre, scaled; 0 below it."""
    return F.greatest((vector_signal(vector, indices) - centre) * scale, F.lit(0.0))


def risk_budget_overlay(risk: Column, centre: float, scale: float, least: float, base: float, low_up: float, high_down: float) -> Column:
    """An overlay between ``low_up`` above the base at no risk and ``high_down`` below it at full risk."""
    gate = least + (1 - least) * scalar.sigmoid(clip((risk - centre) * scale, -30, 30))
    return base + low_up * (1 - gate) - high_down * gate


def describe_overlay(rows: DataFrame, before: str, after: str, bench: float = 1.0, by=SYM) -> DataFrame:
    """Mean, deciles, median and active shares of the overlay, and the share of rows that changed."""
    over = F.col(after) - bench
    share = lambda c: F.avg(c.cast("double"))
    return with_quantiles(rows, over, (0.1, 0.5, 0.9), by).groupBy(*by).agg(
        F.avg(over).alias("mean"), F.first("_q").alias("_q"), share(F.abs(over) > 1e-6).alias("active"),
        share(F.abs(over) > 0.05).alias("active_05"), share(F.abs(F.col(after) - F.col(before)) > 1e-6).alias("remapped"),
    ).select(*by, "mean", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))), "active", "active_05", "remapped")


def soft_labels(df: DataFrame, prev: str, ahead_value: str, into: str = "soft", actions=ACTIONS, bench: float | None = None, unit: float = UNIT, gamma: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """Boltzmann shares of the actions by their values after the real last position.

    ``ahead_value`` holds, for each action, the best worth from the next bar on.
    Advantages are divided by their own deviation, so ``temperature`` has no unit.
    """
    gain, n = 0.0 if bench is None else bench, float(len(actions))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    q = F.array(*((a - gain) * F.col("ret") - unit * F.abs(a - F.col(prev)) + gamma * F.col(ahead_value)[i] for i, a in enumerate(actions)))
    out = settled(df.withColumn("_q", q).withColumn("_top", F.array_max("_q")))
    out = settled(out.withColumn("_a", F.transform("_q", lambda x: x - F.col("_top"))).withColumn("_mean", total(F.col("_a")) / n))
    out = settled(out.withColumn("_dev", F.sqrt(total(F.transform("_a", lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))) / n)))
    out = settled(out.withColumn("_e", F.transform("_a", lambda x: F.exp(x / (F.col("_dev") + 1e-8) / temperature))).withColumn("_all", total(F.col("_e"))))
    return out.withColumn(into, F.transform("_e", lambda x: x / F.col("_all"))).drop("_q", "_top", "_a", "_mean", "_dev", "_e", "_all")


def relabel_bad_underweights(rows: DataFrame, pos: str = "pos", edge: str = "edge", quantile: float = 0.25, bench: float = 1.0, by=SYM) -> DataFrame:
    """``relabelled``: positions below the benchmark whose edge is not above the group's quantile of positive edges become it."""
    bad = (F.col(pos) < bench - 1e-6) & (F.col(edge) <= F.coalesce(F.col("_q")[0], F.lit(0.0)))
    return with_quantiles(rows, F.when(F.col(edge) > 0, F.col(edge)), (quantile,), by).withColumn("relabelled", F.when(bad, bench).otherwise(F.col(pos))).drop("_q")


def normalised_stress(rows: DataFrame, signal: str, by=("sym", "fold")) -> DataFrame:
    """A stress signal as share, 0 to 1, of the way from the median to the ninth decile of the training rows' positive values."""
    x = F.when((F.col("role") == "train") & (F.col(signal) > 0), F.col(signal))
    centre, scale = F.coalesce(F.col("_q")[0], F.lit(0.0)), F.coalesce(F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-6)), F.lit(1.0))
    return with_quantiles(rows, x, (0.5, 0.9), by).withColumn(f"{signal}_share", clip((F.col(signal) - centre) / scale, 0.0, 1.0)).drop("_q")


def route_targets(df: DataFrame, margin: float = 0.0, penalties=(0.0, 0.0, 0.0, 0.0), tau: float = 0.001, smoothing: float = 0.05, actions=ACTIONS, bench: float = 1.0, by=SYM, **costs) -> DataFrame:
    """``scores`` of the four routes, the best route, its advantage, and soft labels.

    A route's score is the best advantage, not below 0, of an action of that
    route, less its penalty; null where it has none.  Routes whose score isn't
    above ``margin`` count as the worst; the neutral one always scores 0.
    """
    out = transition_values(df, actions=actions, bench=bench, by=by, **costs)
    neutral = min(range(len(actions)), key=lambda i: abs(actions[i] - bench))
    at = lambda i: F.element_at("values", i + 1)
    now, base = at(nearest(F.col("pos"), actions)), at(F.lit(neutral))
    gain = [F.greatest(at(F.lit(i)) - base, at(F.lit(i)) - now) for i in range(len(actions))]
    routes = [route(transition_class(F.col("pos"), F.lit(a), bench)) for a in actions]
    scores = [F.greatest(*(F.when(routes[i] == r, F.when(g.isNotNull(), F.greatest(g, F.lit(0.0)))) for i, g in enumerate(gain))) - penalties[r] for r in range(4)]
    out = settled(out.withColumn("scores", F.array(F.lit(0.0), *scores[1:])))
    ranked = F.array_max(F.transform(F.slice("scores", 2, 3), lambda s, i: F.struct(F.coalesce(s, F.lit(-1e300)).alias("s"), (-i).alias("i"))))
    out = out.withColumn("_best", ranked)
    wins = F.col("_best.s") > margin
    gated = F.transform("scores", lambda s, i: F.when(i == 0, 0.0).when(s > margin, s).otherwise(-1e300))
    powers = scalar.softmax(F.transform(gated, lambda s: clip(s / max(tau, 1e-8), -60, 60)))
    return settled(out.withColumns({
        "route": F.when(wins, 1 - F.col("_best.i")).otherwise(0).cast("int"), "route_advantage": F.when(wins, F.col("_best.s")).otherwise(0.0),
        "soft": F.transform(powers, lambda p: (1 - smoothing) * p + smoothing / 4),
    }).drop("_best", "values"))


def route_report(rows: DataFrame) -> DataFrame:
    """(route, n, rate, mean_adv, top_adv, mean_score): one row for each route, empty ones too."""
    limits = {r.route: r.q[0] for r in quantiles(rows, "route_advantage", (0.9,), ("route",), "q").collect()}  # one for each route
    limit = F.array(*(F.lit(limits.get(k)) for k in range(4)))[F.col("route")]
    high = F.when(F.col("route_advantage") >= limit, F.col("route_advantage"))
    each = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.avg("route_advantage").alias("mean_adv"), F.avg(high).alias("top_adv"))
    all_ = rows.agg(F.array(*(F.avg(F.col("scores")[i]) for i in range(4))).alias("s"), F.count(F.lit(1)).alias("_all"))
    scores = all_.select("_all", F.posexplode("s").alias("route", "mean_score"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return scores.join(each, "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("rate"), zero("mean_adv"), zero("top_adv"), "mean_score")


def class_report(rows: DataFrame, name: str = "best_class", value: str = "best_advantage") -> DataFrame:
    """Count, rate, mean, median, outer decile means and positive rate of the advantages of each class."""
    df = rows.where(F.col(value).isNotNull())
    q = quantiles(df, value, (0.1, 0.5, 0.9), (name,))
    v = F.col(value)
    out = df.join(F.broadcast(q), name).groupBy(name, F.col("_q")[1].alias("median")).agg(  # one row for each class
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.avg(F.when(v >= F.col("_q")[2], v)).alias("top_mean"),
        F.avg(F.when(v <= F.col("_q")[0], v)).alias("bottom_mean"), F.avg((v > 0).cast("double")).alias("positive_rate"))
    return out.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each class


def safe_routes(logits: Column, over: Column, under_age: Column, cooldown: Column, gap: float = 0.05, least_age: float = 0.0, boost: float = 2.0, down: float = 8.0, least_share: float = 0.0) -> Column:
    """Route shares from four logits: recovery is favoured and de-risking held back while the overlay has been below the
    benchmark for long enough or is cooling down, and a leading route with too small a share gives way to the neutral one."""
    low = (over < -gap) & (under_age >= least_age) | (cooldown > 0)
    moved = F.transform(logits, lambda x, i: x + F.when(low & (i == ROUTES["recovery"]), boost).when(low & (i == ROUTES["de_risk"]), -down).otherwise(0.0))
    shares = scalar.softmax(moved)
    weak = (first_best(shares) != ROUTES["neutral"]) & (F.array_max(shares) < least_share)
    return F.when(weak, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).otherwise(shares)


def route_overlays(over: Column, step: float = 0.1, low: float = -0.5, high: float = 0.12) -> Column:
    """Where each route takes an overlay in one step: to 0, down, back towards 0, and up."""
    back = clip(over + F.greatest(F.lit(-step), F.least(F.lit(step), -over)), low, high)
    return F.array(F.lit(min(max(0.0, low), high)), F.greatest(over - step, F.lit(low)), back, F.least(over + step, F.lit(high)))
