"""Cost-aware backtests against a constant benchmark position.

``rows`` hold (sym[, fold], ts, ret, pos).  Costs are paid on position changes,
from a flat start, by the strategy and by the benchmark alike.  All figures of
a group come from one window pass and one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.frames import SYM, ordered, run_ids, running
from barline.operators.quantiles import with_quantiles

ANNUAL = 252


def unit_cost(spread_bps: float = 5.0, fee: float = 0.0002, slip_bps: float = 1.0) -> float:
    """Cost of a full position change."""
    return spread_bps / 1e4 / 2 + fee + slip_bps / 1e4


UNIT = unit_cost()


def with_pnl(rows: DataFrame, unit: float = UNIT, bench: float = 1.0, by=SYM) -> DataFrame:
    """Adds cost, pnl and bench_pnl."""
    w = ordered(by)
    cost = unit * F.abs(F.col("pos") - F.lag("pos", 1, 0.0).over(w))
    first = F.lag(F.lit(1), 1, 0).over(w) == 0
    return rows.withColumns({
        "cost": cost, "pnl": F.col("pos") * F.col("ret") - cost,
        "bench_pnl": bench * F.col("ret") - F.when(first, unit * abs(bench)).otherwise(0.0),
    })


def with_equity(rows: DataFrame, by=SYM) -> DataFrame:
    """Adds equity, bench_equity and their drawdowns (peaks leave the start at 1 out)."""
    w = running(by)
    out = rows.withColumns({"equity": F.exp(F.sum("pnl").over(w)), "bench_equity": F.exp(F.sum("bench_pnl").over(w))})
    fall = lambda e: (F.col(e) - F.max(e).over(w)) / (F.max(e).over(w) + 1e-8)
    return out.withColumns({"dd": fall("equity"), "bench_dd": fall("bench_equity")})


def sharpe(x: str, annual: int = ANNUAL) -> Column:
    s = F.stddev_pop(x)
    return F.when(s < 1e-10, 0.0).otherwise(F.avg(x) / s * annual**0.5)


def sortino(x: str, annual: int = ANNUAL) -> Column:
    """Over the deviation of the losses; 99 if there is none and the mean is positive, else 0."""
    s = F.stddev_pop(F.when(F.col(x) < 0, F.col(x)))
    return F.when(s.isNull() | (s < 1e-10), F.when(F.avg(x) > 0, 99.0).otherwise(0.0)).otherwise(F.avg(x) / s * annual**0.5)


def total(x: str) -> Column:
    return F.exp(F.sum(x)) - 1


def annual_return(r: Column, n: Column, annual: int = ANNUAL) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.pow(F.greatest(1 + r, F.lit(1e-12)), annual / n) - 1)


def calmar(r: Column, mdd: Column, n: Column, annual: int = ANNUAL) -> Column:
    return F.when(F.abs(mdd) < 1e-10, F.when(r > 0, 99.0).otherwise(0.0)).otherwise(r / (n / annual) / F.abs(mdd))


def summary(rows: DataFrame, by=SYM, annual: int = ANNUAL, unit: float = UNIT) -> DataFrame:
    """The headline figures of each group."""
    df = with_equity(with_pnl(rows, unit, by=by), by)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bars"), sharpe("pnl", annual).alias("sharpe"), sharpe("bench_pnl", annual).alias("bench_sharpe"),
        total("pnl").alias("total_return"), total("bench_pnl").alias("bench_return"), F.min("dd").alias("max_dd"), F.min("bench_dd").alias("bench_dd"), F.sum("cost").alias("cost"),
    )
    return out.withColumns({"final_excess": F.col("total_return") - F.col("bench_return"), "sharpe_delta": F.col("sharpe") - F.col("bench_sharpe"), "maxdd_delta": F.abs("max_dd") - F.abs("bench_dd")})


def full(rows: DataFrame, by=SYM, annual: int = ANNUAL, unit: float = UNIT) -> DataFrame:
    """All per-group figures of a backtest."""
    df = with_equity(with_pnl(rows, unit, by=by), by).withColumns({
        "turn": F.col("pos") != F.lag("pos", 1, 0.0).over(ordered(by)),
        "starts": F.coalesce(F.col("pos") != F.lag("pos").over(ordered(by)), F.lit(True)),
    })
    up, down = F.col("bench_pnl") > 0, F.col("bench_pnl") < 0

    def capture(side: Column) -> Column:
        under = F.sum(F.when(side, F.col("bench_pnl")))
        return F.when(F.abs(under) >= 1e-12, F.sum(F.when(side, F.col("pnl"))) / under)

    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bars"), sharpe("pnl", annual).alias("sharpe"), sortino("pnl", annual).alias("sortino"), total("pnl").alias("total_return"),
        total("bench_pnl").alias("bench_return"), F.min("dd").alias("max_dd"), F.min("bench_dd").alias("bench_max_dd"),
        F.count_if("turn").alias("n_trades"), (F.count(F.lit(1)) / F.count_if("starts")).alias("avg_hold"),
        F.avg((F.col("pnl") > F.col("bench_pnl")).cast("double")).alias("bar_win_rate"), capture(up).alias("up_capture"), capture(down).alias("down_capture"),
    )
    n = F.col("bars")
    return out.withColumns({
        "calmar": calmar(F.col("total_return"), F.col("max_dd"), n, annual), "annual_return": annual_return(F.col("total_return"), n, annual),
        "annual_alpha": annual_return(F.col("total_return"), n, annual) - annual_return(F.col("bench_return"), n, annual),
        "final_excess": F.col("total_return") - F.col("bench_return"), "maxdd_delta": F.abs("max_dd") - F.abs("bench_max_dd"),
    })


def local_drawdown(rows: DataFrame, pnl: str = "pnl", into: str = "local_dd", by=SYM) -> DataFrame:
    """How far equity, from these returns' start, lies below its highest so far, 0 at a peak."""
    equity = rows.withColumn("_e", F.exp(F.sum(pnl).over(running(by))))
    below = 1 - F.col("_e") / F.greatest(F.max("_e").over(running(by)), F.lit(1e-12))
    return equity.withColumn(into, F.greatest(below, F.lit(0.0))).drop("_e")


def attribution(rows: DataFrame, by=SYM, unit: float = UNIT) -> DataFrame:
    """Gross pnl of long and short positions, costs and what is left."""
    gross = F.col("pos") * F.col("ret")
    return with_pnl(rows, unit, by=by).groupBy(*by).agg(
        F.sum(F.when(F.col("pos") > 0, gross).otherwise(0.0)).alias("long_gross"), F.sum(F.when(F.col("pos") < 0, gross).otherwise(0.0)).alias("short_gross"),
        F.sum("cost").alias("cost_total"), F.sum("pnl").alias("net_total"),
    )


def period_win_rate(rows: DataFrame, period: int, by=SYM) -> DataFrame:
    """Share of blocks of ``period`` bars whose pnl beats the benchmark's; the last may be short."""
    block = F.floor((F.row_number().over(ordered(by)) - 1) / period)
    blocks = with_pnl(rows, by=by).withColumn("block", block).groupBy(*by, "block").agg((F.sum("pnl") - F.sum("bench_pnl")).alias("ahead"))
    return blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), F.avg((F.col("ahead") > 0).cast("double")).alias("win_rate"))


def holding_runs(rows: DataFrame, by=SYM) -> DataFrame:
    """Runs of equal positions: their number, mean and longest length."""
    marked = rows.withColumn("was", F.lag("pos").over(ordered(by)))
    runs = run_ids(marked, F.col("pos") != F.col("was"), by=by).groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean_hold"), F.max("n").alias("longest"))


def underperformance(rows: DataFrame, by=SYM) -> DataFrame:
    """The longest stretch of bars that don't beat the benchmark."""
    df = with_pnl(rows, by=by).withColumn("under", F.col("pnl") <= F.col("bench_pnl")).withColumn("was", F.lag("under").over(ordered(by)))
    runs = run_ids(df, F.col("under") != F.col("was"), by=by).where("under").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*by).distinct().join(runs.groupBy(*by).agg(F.max("n").alias("n")), list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("longest_under"))


def recovery_latency(rows: DataFrame, bench: float = 1.0, eps: float = 1e-6, by=SYM) -> DataFrame:
    """Lengths of runs below the benchmark position that end before the data does."""
    marked = rows.withColumn("low", F.col("pos") < bench - eps).withColumn("was", F.lag("low").over(ordered(by)))
    runs = run_ids(marked, F.col("low") != F.col("was"), by=by).groupBy(*by, "run").agg(F.bool_or("low").alias("low"), F.count(F.lit(1)).alias("n"))
    last = runs.groupBy(*by).agg(F.max("run").alias("last"))
    closed = runs.join(last, list(by)).where("low and run < last")
    return closed.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"))


def by_regime(rows: DataFrame, regime: str, least: int = 10, by=SYM) -> DataFrame:
    """Backtests of each regime's rows put end to end (costs where they meet), if there are enough."""
    keys = (*by, regime)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    return summary(rows, keys).where(F.col("bars") >= least).join(size, list(by)).withColumn("fraction", F.col("bars") / F.col("_all")).drop("_all")


def action_stats(rows: DataFrame, bench: float = 1.0, flat: float = 0.05, by=SYM) -> DataFrame:
    """Shares of long, short and flat overlays, turnover over inner steps, hard switches, mean hold."""
    over = F.col("pos") - bench
    step = F.abs(F.col("pos") - F.lag("pos").over(ordered(by)))
    df = rows.withColumns({"over": over, "step": step})
    ref = F.greatest(F.coalesce(F.col("_q")[0], F.lit(0.0)), F.lit(0.05))
    return with_quantiles(df, F.when(F.col("step") > 1e-8, F.col("step")), (0.9,), by).withColumn("step_ref", ref).groupBy(*by, "step_ref").agg(
        F.avg((F.col("over") > flat).cast("double")).alias("long_share"), F.avg((F.col("over") < -flat).cast("double")).alias("short_share"),
        F.avg((F.abs("over") <= flat).cast("double")).alias("flat_share"), F.avg("over").alias("mean_overlay"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.sum(F.rint(F.col("step") / F.col("step_ref"))), F.lit(0.0)).alias("switches"), (F.count(F.lit(1)) / F.greatest(F.coalesce(F.sum(F.rint(F.col("step") / F.col("step_ref"))), F.lit(0.0)), F.lit(1.0))).alias("avg_hold"),
    )
