"""Returns and rewards over short episodes, and two-hot encodings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.backtest import UNIT
from barline.operators.quantiles import at_places


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def symexp(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def lambda_returns(rewards: Column, values: Column, last: Column, gamma: float = 0.99, lam: float = 0.95) -> Column:
    """Backward recurrence in symlog space over an episode's arrays; one value for each step."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))
    start = F.struct(symlog(last).alias("g"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        g = symlog(x["r"]) + gamma * ((1 - lam) * symlog(x["v"]) + lam * s["g"])
        return F.struct(g.alias("g"), F.concat(F.array(g), s["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def net_returns(steps: DataFrame, by=("episode",), unit: float = UNIT, bench: float | None = None, into: str = "net") -> DataFrame:
    """Returns of each sequence's positions from a flat start, less costs, and less the benchmark's if it is given."""
    traded = F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(Window.partitionBy(*by).orderBy("step")))
    return steps.withColumn(into, (F.col("pos") - (bench or 0.0)) * F.col("ret") - unit * traded)


def rollout_rewards(steps: DataFrame, by=("episode",), bench: float = 1.0, unit: float = UNIT, dd: float = 0.5, leverage: float = 0.1) -> DataFrame:
    """Excess over the benchmark less costs, growing drawdown and leverage, by step of an episode."""
    w = Window.partitionBy(*by).orderBy("step")
    cum = F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = steps.withColumn("net", F.col("pos") * F.col("ret") - unit * F.abs(F.col("pos") - F.lag("pos", 1, bench).over(w)))
    out = out.withColumn("_c", cum).withColumn("level", F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    worse = F.greatest(F.col("level") - F.lag("level", 1, 0.0).over(w), F.lit(0.0))
    return out.withColumn("reward", F.col("net") - bench * F.col("ret") - dd * worse - leverage * F.greatest(F.col("pos") - bench, F.lit(0.0))).drop("_c")


def two_hot(x: Column, low: float, high: float, bins: int) -> Column:
    """(lower bin, weight of the bin above) of a value on an even grid."""
    at = (F.greatest(F.lit(low), F.least(F.lit(high), x)) - low) / ((high - low) / (bins - 1))
    lower = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
    return F.struct(lower.alias("bin"), (at - lower).alias("upper"))


def two_hot_value(bin_: Column, upper: Column, low: float, high: float, bins: int) -> Column:
    """The value that ``two_hot`` stands for (bounded to the grid)."""
    return low + (bin_ + upper) * ((high - low) / (bins - 1))


def soft_label(x: Column, grid: tuple[float, ...]) -> Column:
    """Weights on a sorted grid, shared between the two neighbours of a value."""
    bounded = F.greatest(F.lit(grid[0]), F.least(F.lit(grid[-1]), x))
    out = []
    for i, g in enumerate(grid):
        rise = (bounded - grid[i - 1]) / (g - grid[i - 1]) if i else None
        fall = (grid[i + 1] - bounded) / (grid[i + 1] - g) if i + 1 < len(grid) else None
        w = F.lit(0.0)
        if fall is not None:
            w = F.when((bounded >= g) & (bounded <= grid[i + 1]), fall).otherwise(w)
        if rise is not None:
            w = F.when((bounded >= grid[i - 1]) & (bounded < g) | ((i + 1 == len(grid)) & (bounded == g)), rise).otherwise(w)
        out.append(w)
    return F.array(*out)


def anchor_bank(vectors: DataFrame, bank_size: int, vec_id: str = "vec_id") -> DataFrame:
    """``bank_size`` rows of ``vectors``, evenly spaced over all rows in the order of their ids; all rows if fewer.

    Only ids and hashes of rows are sorted, in ranges; of equal rows one stands for all.
    """
    total = vectors.count()
    if total <= bank_size:
        return vectors
    marked = vectors.withColumn("_mark", F.xxhash64(*(c for c in vectors.columns if c != vec_id)))
    places = np.linspace(0, total - 1, num=bank_size, dtype=np.int64).tolist()
    picked = at_places(marked, (vec_id, "_mark"), places).select(F.col(vec_id).alias("_id"), F.col("_mark").alias("_row"))  # as many rows as the bank has
    return marked.join(picked, F.col(vec_id).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_row")), "left_semi").dropDuplicates([vec_id, "_mark"]).drop("_mark")


def nearest_anchor(vectors: DataFrame, anchors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, anchor, distance): the nearest of a fixed bank of anchors by Euclidean distance of unit vectors.

    The bank is a bounded sample that becomes one array, sent to every task; no
    row is multiplied and nothing is shuffled.
    """
    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))

    bank = anchors.agg(F.collect_list(F.struct(F.col(vec_id).alias("anchor"), unit(F.col(embedding)).alias("b"))).alias("_bank"))  # one row
    far = lambda b: F.sqrt(F.aggregate(F.zip_with("_a", b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = F.array_min(F.transform("_bank", lambda e: F.struct(far(e["b"]).alias("d"), e["anchor"].alias("anchor"))))
    found = vectors.select(vec_id, unit(F.col(embedding)).alias("_a")).join(F.broadcast(bank), F.lit(True)).select(vec_id, near.alias("m"))
    return found.select(vec_id, F.col("m.anchor").alias("anchor"), F.col("m.d").alias("distance"))


def reward_scale(batches: DataFrame, value: str = "net", batch: str = "batch", decay: float = 0.99, by=()) -> DataFrame:
    """(by, batch, low, high, scale): running 5th and 95th percentiles over the batches, and their distance, 1 at least.

    Percentiles come from one grouped aggregate; the running mean is a fold
    over the batches' two figures.
    """
    q = batches.groupBy(*by, batch).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    before = Window.partitionBy(*by).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)

    def mean(i: int) -> Column:
        seen = F.transform(F.collect_list("q").over(before), lambda x: x[i])
        return F.aggregate(F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(0))), seen[0], lambda s, x: decay * s + (1 - decay) * x)

    out = q.select(*by, batch, mean(0).alias("low"), mean(1).alias("high"))
    return out.withColumn("scale", F.greatest(F.lit(1.0), F.col("high") - F.col("low")))


#: Weights of the constrained rewards.
CONSTRAINT = {"wealth": 1.0, "dd": 0.0, "dd_budget": 0.0, "dd_better": 0.0, "end_dd": 0.0, "end_better": 0.0, "floor": 0.0, "floor_weight": 0.0, "tail": 0.0, "tail_margin": 0.0, "level": 0.0, "downside": 0.0}
#: Weights of penalties on the overlay itself.
EXPOSURE = {"l2": 0.0, "short": 0.0, "over": 0.0, "absolute": 0.0, "risk": 0.0, "tilt": 0.0, "edge": 0.0}


def _plus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def exposure_terms(overlay: Column, bench: float, risk: Column | None, edge: Column | None, weights: dict | None = None) -> Column:
    """What an overlay costs by its size, side, exposure and the present risk, less what its edge is worth."""
    k = EXPOSURE | (weights or {})
    held, risk, edge = overlay + bench, F.lit(0.0) if risk is None else risk, F.lit(0.0) if edge is None else edge
    return (
        -k["l2"] * overlay * overlay - k["short"] * _plus(-overlay) - k["over"] * _plus(overlay) - k["absolute"] * held * held - k["risk"] * risk * held * held
        - k["tilt"] * risk * overlay + k["edge"] * edge * overlay
    )


def constrained_rewards(steps: DataFrame, kind: str = "relative", scale: float = 1.0, by=("episode",), weights: dict | None = None, exposure: dict | None = None, bench: float = 1.0) -> DataFrame:
    """``reward`` of each step of an episode, by one of three functionals.

    "budget": growth of ``net`` less drawdown levels, what is over a budget,
    the last level, losses and tails.  "relative": growth of ``net`` (already
    over the benchmark) less its drawdowns below the path's peak or its start,
    a shortfall at the end and tails.  "absolute": growth of ``net`` over
    ``bench_net``, and how much deeper or shallower the drawdown is.  All have
    the exposure terms of ``over`` (``risk`` and ``edge`` where there are such
    columns).
    """
    k = CONSTRAINT | (weights or {})
    order = Window.partitionBy(*by).orderBy("step")
    so_far, all_ = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(-0.95)))
    df = steps.withColumn("_g", log("net") - (log("bench_net") if kind == "absolute" else F.lit(0.0)))
    if kind == "budget":
        df = df.withColumn("_path", F.sum("net").over(so_far)).withColumn("_dd", F.max("_path").over(so_far) - F.col("_path"))
        worse, better, tail = _plus(F.col("_dd") - k["dd_budget"]), F.lit(0.0), _plus(-F.col("net") - k["tail_margin"])
    elif kind == "relative":
        df = df.withColumn("_path", F.sum("_g").over(so_far)).withColumn("_dd", F.greatest(F.max("_path").over(so_far), F.lit(0.0)) - F.col("_path"))
        worse, better, tail = _plus(F.col("_dd") - k["dd_budget"]), F.lit(0.0), _plus(-F.col("net") - k["tail_margin"])
    else:
        df = df.withColumns({"_a": F.sum(log("net")).over(so_far), "_b": F.sum(log("bench_net")).over(so_far), "_path": F.sum("_g").over(so_far)})
        df = df.withColumn("_dd", F.max("_a").over(so_far) - F.col("_a") - F.max("_b").over(so_far) + F.col("_b"))
        worse, better, tail = _plus(F.col("_dd") - k["dd_budget"]), _plus(-F.col("_dd") - k["dd_budget"]), _plus(-F.col("_g") - k["tail_margin"])
    df = df.withColumns({"_end_dd": F.max_by("_dd", "step").over(all_), "_end": F.max_by("_path", "step").over(all_), "_n": F.count(F.lit(1)).over(all_)})
    budget = 0.0 if kind == "budget" else k["dd_budget"]
    if kind == "absolute":
        end = k["end_dd"] * _plus(F.col("_end_dd") - budget) - k["end_better"] * _plus(-F.col("_end_dd") - budget)
    else:
        end = k["end_dd"] * F.col("_end_dd")
    value = (
        k["wealth"] * F.col("_g") - k["level"] * F.col("_dd") - k["dd"] * worse + k["dd_better"] * better - end - k["tail"] * tail
        - (k["floor_weight"] * _plus(k["floor"] - F.col("_end")) / F.col("_n") if kind != "budget" else F.lit(0.0)) - k["downside"] * _plus(-F.col("net"))
    )
    extra = exposure_terms(F.col("over"), bench, *(F.col(c) if c in steps.columns else None for c in ("risk", "edge")), exposure)
    return df.withColumn("reward", value / scale + extra).drop(*(c for c in df.columns if c.startswith("_")))


def drawdown_rewards(steps: DataFrame, beta: float, scale: float = 1.0, by=("episode",)) -> DataFrame:
    """``reward``: scaled net return less ``beta`` times the drawdown level."""
    so_far = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    df = steps.withColumn("_c", F.sum("net").over(so_far))
    return df.withColumn("reward", F.col("net") / scale - beta * (F.max("_c").over(so_far) - F.col("_c"))).drop("_c")


def smooth_l1(pred: Column, target: Column) -> Column:
    d = F.abs(pred - target)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def bce_with_logits(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Cross-entropy of a logit; positive targets may weigh more."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    return pos_weight * target * (soft + _plus(-logit)) + (1 - target) * (soft + _plus(logit))


def masked_losses(rows: DataFrame, losses: dict[str, tuple[Column, Column]], by=()) -> DataFrame:
    """Means of losses, each over the rows that its mask keeps and where it is finite; 0 where there are none."""
    ok = lambda x, mask: F.when(mask & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return rows.groupBy(*by).agg(*(F.coalesce(F.avg(ok(x, mask)), F.lit(0.0)).alias(name) for name, (x, mask) in losses.items()))


def ranking_loss(pred: Column, target: Column) -> Column:
    """Cross-entropy of an array of scores against the place of the largest target."""
    top = F.array_max(pred)
    total = top + F.ln(F.aggregate(pred, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    best = F.array_max(F.transform(target, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))["i"]
    return total - F.element_at(pred, 1 - best)
