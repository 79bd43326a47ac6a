"""Overfitting diagnostics: probability of backtest overfitting, deflated Sharpe."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unranked(rank: int, n: int, k: int) -> list[int]:
    """The subset with this number among the k-subsets of 0 to n - 1, largest first: by the sum of binomials that the number is."""
    taken = []
    for i in range(n - 1, -1, -1):
        if k and rank >= math.comb(i, k):
            taken, rank, k = [*taken, i], rank - math.comb(i, k), k - 1
    return taken


def _subsets(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(taken): all k-subsets of 0 to n - 1, each from its number, so that tasks share them out."""
    choose = F.array(*(F.array(*(F.lit(math.comb(i, j)).cast("long") for j in range(k + 1))) for i in range(n)))
    start = F.struct(F.col("id").alias("rank"), F.lit(k).alias("k"), F.array().cast("array<int>").alias("taken"))

    def step(s, i):
        below = F.get(F.get(choose, i), s["k"])
        take = (s["k"] > 0) & (s["rank"] >= below)
        return F.struct(F.when(take, s["rank"] - below).otherwise(s["rank"]).alias("rank"), F.when(take, s["k"] - 1).otherwise(s["k"]).alias("k"), F.when(take, F.concat(s["taken"], F.array(i))).otherwise(s["taken"]).alias("taken"))

    places = F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1))
    return spark.range(math.comb(n, k)).select(F.aggregate(places, start, step, lambda s: s["taken"]).alias("taken"))


def pbo(fold_scores: DataFrame, score: str = "score", exact: int = 20, sample: int = 4096, seed: int = 42) -> DataFrame:
    """One row: share of the half-size subsets of folds whose best is above the rest's best, and their number; 0.5 for one fold.

    Up to ``exact`` folds all subsets count.  With more, ``sample`` different
    ones do, whose numbers are drawn with ``seed``; a subset follows from its
    number, so any number of folds will do.
    """
    spark, n = fold_scores.sparkSession, fold_scores.count()
    half, total = n // 2, math.comb(n, n // 2)
    if n < 2:
        return spark.createDataFrame([(0.5, 0)], "pbo double, subsets long")
    if n <= exact or total <= sample:
        subsets = _subsets(spark, n, half)
    else:
        rng, ranks = random.Random(seed), set()
        while len(ranks) < sample:
            ranks.add(rng.randrange(total))
        subsets = spark.createDataFrame([(unranked(r, n, half),) for r in sorted(ranks)], "taken array<int>")
    one = fold_scores.agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", F.col(score).alias("s")))), lambda x: x["s"]).alias("s"))  # one row
    inside = F.array_max(F.transform("taken", lambda i: F.get("s", i)))
    outside = F.array_max(F.filter(F.transform("s", lambda x, i: F.when(~F.array_contains("taken", i), x)), lambda x: x.isNotNull()))
    return subsets.join(F.broadcast(one), F.lit(True)).agg(F.avg((inside > outside).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("subsets"))


def p_value(z: Column) -> Column:
    """Share of the normal distribution above z, to about 1e-7 (a rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # FIXED VALUES: coefficients of the normal distribution's tail
    tail = sum((F.lit(c) * F.pow(t, F.lit(k)) for k, c in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1)), F.lit(0.0))
    above = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * tail
    return F.when(z >= 0, above).otherwise(1 - above)


def expected_maximum(trials: int) -> float:
    return NormalDist().inv_cdf(1 - 1 / trials) if trials > 1 else 0.0


def deflated_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, trials: int = 1) -> Column:
    """z of a Sharpe ratio against the best expected of ``trials``; kurtosis is not in excess."""
    variance = (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / F.greatest(n - 1, F.lit(1))
    return (sr - expected_maximum(trials)) / F.sqrt(F.greatest(variance, F.lit(1e-10)))


def moments(x: str, least: int = 20) -> tuple[Column, Column]:
    """Population skew and kurtosis; 0 and 3 for fewer than ``least`` rows."""
    few = F.count(x) < least
    return F.when(few, 0.0).otherwise(F.skewness(x)), F.when(few, 3.0).otherwise(F.kurtosis(x) + 3)


def upper_tail(z: float) -> float:
    """P(Z > z) of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))
