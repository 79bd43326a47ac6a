"""Scoring, rejecting and choosing policy candidates; scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Goals that a policy is held against.
GOALS = {"alpha_pt": 3.0, "sharpe_delta": 0.20, "maxdd_pt": -3.0, "win_rate": 0.60, "stretch_alpha_pt": 10.0, "stretch_maxdd_pt": -5.0}


def validation_score(alpha: Column, dd: Column, turnover: Column) -> Column:
    """Twice alpha, six times a worse drawdown off, twice a better one on, half the turnover off."""
    return 2 * alpha - 6 * F.greatest(dd, F.lit(0.0)) + 2 * F.greatest(-dd, F.lit(0.0)) - 0.5 * turnover


def scorecard(metrics: DataFrame, goals: dict = GOALS) -> DataFrame:
    """Required and stretch goals of rows with alpha_pt, sharpe_delta, maxdd_pt, win_rate and action shares."""
    collapse = (F.greatest("long_share", "short_share") >= 0.80) & (F.col("switches") <= 5) & (F.col("turnover") < 1.0)
    out = metrics.withColumns({
        "ok_alpha": F.col("alpha_pt") >= goals["alpha_pt"], "ok_sharpe": F.col("sharpe_delta") >= goals["sharpe_delta"],
        "ok_maxdd": F.col("maxdd_pt") <= goals["maxdd_pt"], "ok_win_rate": F.col("win_rate") >= goals["win_rate"], "ok_collapse": ~collapse,
        "stretch_hit": (F.col("alpha_pt") >= goals["stretch_alpha_pt"]) | (F.col("maxdd_pt") <= goals["stretch_maxdd_pt"]),
    })
    return out.withColumn("m2_pass", F.col("ok_alpha") & F.col("ok_sharpe") & F.col("ok_maxdd") & F.col("ok_win_rate") & F.col("ok_collapse"))


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


#: Order of near-best candidates by mode.
TIEBREAKS = {
    "conservative": ("hold_last", "turnover", "maxdd_pt", "-win_rate", "-score"),
    "balanced": ("-sharpe_delta", "maxdd_pt", "-win_rate", "turnover", "-score"),
    "score": ("-score", "-sharpe_delta", "maxdd_pt", "turnover"),
}


#: What an active candidate must reach to be preferred to holding the benchmark.
ACTIVE = {"alpha": 8.0, "maxdd": 0.0, "win_rate": 0.48, "margin": 5.0, "sharpe": 0.05}


def choose(candidates: DataFrame, by=("sym",), mode: str = "conservative", alpha_tol: float = 5.0, sharpe_tol: float = 0.2, score_tol: float = 15.0, active: dict | None = None) -> DataFrame:
    """One candidate of each group.

    Rejected candidates count only if all are.  The best score (first by
    ``cand`` on ties) sets the band; the benchmark's own candidate is taken
    instead of an active best that is not strong; otherwise the first of the
    near-best in the mode's order.  Columns: cand, score, alpha_pt,
    sharpe_delta, maxdd_pt, win_rate, turnover, m2_pass, stretch_hit, hold
    (boolean), reject.
    """
    active = ACTIVE | (active or {})
    group = Window.partitionBy(*by)
    pool = candidates.withColumn("_ok", F.max(F.col("reject").isNull().cast("int")).over(group)).where((F.col("_ok") == 0) | F.col("reject").isNull())
    row = F.struct("score", "alpha_pt", "sharpe_delta", "maxdd_pt", "win_rate", "m2_pass", "stretch_hit", "hold")
    pool = pool.withColumn("_b", F.max_by(row, F.struct("score", -F.col("cand"))).over(group))
    pool = pool.withColumn("_h", F.min(F.when(F.col("hold"), F.col("cand"))).over(group))
    pool = pool.withColumn("_hs", F.max(F.when(F.col("cand") == F.col("_h"), F.col("score"))).over(group))
    b = F.col("_b")
    strong = (
        (b["alpha_pt"] >= active["alpha"]) & (b["maxdd_pt"] <= active["maxdd"]) & (b["win_rate"] >= active["win_rate"])
        & (b["score"] >= F.col("_hs") + active["margin"]) & (b["m2_pass"] | (b["stretch_hit"] & (b["sharpe_delta"] >= active["sharpe"])))
    )
    held = F.col("_h").isNotNull() & ~b["hold"] & ~strong
    near = (F.col("score") >= b["score"] - score_tol) & (F.col("alpha_pt") >= b["alpha_pt"] - alpha_tol) & (F.col("sharpe_delta") >= b["sharpe_delta"] - sharpe_tol)
    keys = [F.when(F.col("hold"), 0).otherwise(1) if k == "hold_last" else (-F.col(k[1:]) if k[0] == "-" else F.col(k)) for k in TIEBREAKS[mode]]
    taken = pool.where((held & (F.col("cand") == F.col("_h"))) | (~held & near))
    first = Window.partitionBy(*by).orderBy(*keys, "cand")
    return taken.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_ok", "_b", "_h", "_hs")


def family_summary(metrics: DataFrame, by: str = "method") -> DataFrame:
    """Count, mean, median and worst alpha, drawdown figures and goals met, by policy family."""
    return metrics.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("alpha_pt").alias("alpha_mean"), F.percentile("alpha_pt", F.lit(0.5)).alias("alpha_median"), F.min("alpha_pt").alias("alpha_worst"),
        F.avg("maxdd_pt").alias("maxdd_mean"), F.percentile("maxdd_pt", F.lit(0.5)).alias("maxdd_median"), F.max("maxdd_pt").alias("maxdd_worst"),
        F.count_if(F.col("maxdd_pt") <= 0).alias("dd_improved"), F.avg("turnover").alias("turnover_mean"),
    )
