"""Diagnostics of position paths: drawdown intervals, fires, markers, blocks, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.frames import SYM, ahead, ordered, run_ids, running
from barline.operators import backtest


def maxdd_interval(rows: DataFrame, by=SYM) -> DataFrame:
    """First trough of the deepest drawdown, and the first row of the peak before it (numbers from 0)."""
    df = backtest.with_equity(backtest.with_pnl(rows, by=by), by).withColumn("i", F.row_number().over(ordered(by)) - 1)
    trough = df.groupBy(*by).agg(F.min(F.struct("dd", "i")).alias("t")).select(*by, F.col("t.i").alias("trough"), F.col("t.dd").alias("max_dd"))
    before = df.join(trough, list(by)).where("i <= trough")
    return before.groupBy(*by, "trough", "max_dd").agg((-F.max(F.struct("equity", (-F.col("i")).alias("k")))["k"]).alias("peak"))


def fire_runs(rows: DataFrame, fire: str, by=SYM) -> DataFrame:
    """Runs of consecutive fires: first row and the row after the last (numbers from 0)."""
    df = rows.withColumn("i", F.row_number().over(ordered(by)) - 1).withColumn("was", F.lag(fire).over(ordered(by)))
    return run_ids(df, F.col(fire) != F.col("was"), by=by).where(fire).groupBy(*by, "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("run")


def trade_markers(rows: DataFrame, eps: float = 1e-4, by=SYM) -> DataFrame:
    """Rows whose position moves by more than ``eps``; never a group's first."""
    before = F.lag("pos").over(ordered(by))
    return rows.withColumn("before", before).where(F.abs(F.col("pos") - F.col("before")) > eps).select(*by, "ts", "before", F.col("pos").alias("after"), (F.col("pos") - F.col("before")).alias("delta"))


def active_blocks(rows: DataFrame, bench: float = 1.0, eps: float = 0.05, by=SYM) -> DataFrame:
    """Runs away from the benchmark: first and last row (numbers from 0)."""
    df = rows.withColumn("on", F.abs(F.col("pos") - bench) > eps)
    return fire_runs(df, "on", by).select(*by, "start", (F.col("stop") - 1).alias("end"))


def fire_metrics(rows: DataFrame, horizons=(4, 8), by=SYM) -> DataFrame:
    """What an adapted path (``pos``) gains over the base path (``base``) where they differ, and forward returns there."""
    df = rows.withColumn("fire", F.abs(F.col("pos") - F.col("base")) > 1e-8)
    df = df.withColumn("gain", (F.col("pos") - F.col("base")) * F.col("ret"))
    df = df.withColumns({f"fwd_{h}": F.sum("ret").over(ahead(0, h - 1, by)) for h in horizons})
    hit = F.col("fire")
    return df.groupBy(*by).agg(
        F.count_if(hit).alias("fires"), F.avg(hit.cast("double")).alias("fire_rate"), F.coalesce(F.sum(F.when(hit, F.col("gain"))), F.lit(0.0)).alias("incremental"),
        *(F.avg(F.when(hit, F.col(f"fwd_{h}"))).alias(f"fwd_{h}") for h in horizons),
    )


def sequence_windows(rows: DataFrame, length: int, value: str, by=SYM) -> DataFrame:
    """(…, ts, window): the array of this and the next values, where there are ``length``."""
    w = ahead(0, length - 1, by)
    return rows.withColumn("window", F.collect_list(value).over(w)).where(F.size("window") == length).select(*by, "ts", "window")


def controller_state(rows: DataFrame, bench: float = 1.0, cap: int = 64, cooldown: int = 0, eps: float = 1e-6, by=SYM) -> DataFrame:
    """State before each bar: overlay, last change, bars since the last trade, bars below the benchmark, and what is left
    of the ``cooldown`` bars after a rise from below it (all ages as shares of ``cap``)."""
    w = ordered(by)
    df = rows.withColumn("over", F.lag("pos", 1, bench).over(w) - bench)
    df = df.withColumn("delta", F.col("over") - F.lag("over", 1, 0.0).over(w)).withColumn("low", F.col("over") < -eps).withColumn("was", F.lag("low").over(w))
    df = run_ids(df, F.abs(F.col("delta")) > eps, "_h", by)
    df = run_ids(df, F.col("low") != F.col("was"), "_u", by)
    df = df.withColumn("_n", F.row_number().over(w))
    rise = F.last(F.when(F.col("low") & (F.col("delta") > eps), F.col("_n")), ignorenulls=True).over(running(by))
    age = lambda k, less: F.least((F.row_number().over(ordered((*by, k))) - less) / cap, F.lit(1.0))
    left = F.greatest(F.lit(min(1.0, cooldown / cap)) - (F.col("_n") - rise) / cap, F.lit(0.0))
    return df.withColumns({
        "hold_age": age("_h", 1), "under_age": F.when(F.col("low"), age("_u", 0)).otherwise(0.0), "cooldown": F.coalesce(left, F.lit(0.0)),
    }).drop("_h", "_u", "_n", "was", "low")


def regime_prior(rows: DataFrame, label: str = "label", probs: str = "regime", shrink: float = 64.0) -> DataFrame:
    """Mass-weighted label rates by regime, shrunk towards the overall rate, and centred logits."""
    long = rows.select(F.col(label).cast("double").alias("y"), F.posexplode(probs).alias("regime", "p"))
    all_ = rows.agg(F.avg(F.col(label).cast("double")).alias("base"))
    by = long.groupBy("regime").agg(F.sum("p").alias("mass"), (F.sum(F.col("p") * F.col("y")) / F.sum("p")).alias("rate"))
    out = by.join(F.broadcast(all_), F.lit(True)).withColumn("rate", F.col("base") + (F.col("mass") / (F.col("mass") + shrink)) * (F.col("rate") - F.col("base")))
    logit = lambda x: F.ln(F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6))))
    return out.select("regime", "mass", "rate", (logit(F.col("rate")) - logit(F.col("base"))).alias("logit"))
