"""Sample, class and trade weights, and chunked actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.frames import SYM, clip, ordered
from barline.operators.quantiles import with_quantiles


def _with_quantiles(rows: DataFrame, edge: str, quantiles: tuple[float, ...], by) -> DataFrame:
    """``_q``: quantiles of the positive values of each group, null where it has none."""
    positive = F.when(F.col(edge) > 0, F.col(edge))
    return with_quantiles(rows, positive, quantiles, by)


def quality_weights(rows: DataFrame, edge: str, into: str = "quality", quantile: float = 0.75, bound: float = 4.0, by=SYM) -> DataFrame:
    """How far an edge lies above the floor of its group's positive edges, in steps up to their ninth decile."""
    q = F.col("_q")
    value = clip((F.col(edge) - q[0]) / F.greatest(q[1] - q[0], F.lit(1e-6)), 0.0, bound)
    return _with_quantiles(rows, edge, (quantile, 0.9), by).withColumn(into, F.when(q.isNull(), 0.0).otherwise(value)).drop("_q")


def quality_edge(mode: str, signal: str, edge: str, pos: str = "pos", bench: float = 1.0) -> Column:
    """What ``quality_weights`` may weigh: "outcome_edge", "underweight_edge" (how far below the benchmark while the edge is
    negative) or "abs_signal", which is a weight by itself."""
    if mode == "abs_signal":
        return F.abs(signal)
    if mode == "underweight_edge":
        return F.greatest(bench - F.col(pos), F.lit(0.0)) * F.greatest(-F.col(edge), F.lit(0.0))
    return F.col(edge)


def advantage_scale(rows: DataFrame, edge: str, into: str = "advantage", by=SYM) -> DataFrame:
    """An edge as a share of the ninth decile of its group's positive edges, in [0, 1]."""
    q = F.col("_q")
    value = clip(F.col(edge) / F.greatest(q[0], F.lit(1e-6)), 0.0, 1.0)
    return _with_quantiles(rows, edge, (0.9,), by).withColumn(into, F.when(q.isNull(), 0.0).otherwise(value)).drop("_q")


def class_weights(rows: DataFrame, label: Column, classes: int, by=SYM) -> DataFrame:
    """(class, n, weight) of each group: weights fall with the count and have mean 1 over all classes."""
    counts = rows.groupBy(*by).agg(F.array(*(F.count_if(label == k) for k in range(classes))).alias("_n"))
    total = F.aggregate("_n", F.lit(0).cast("long"), lambda s, n: s + n)
    raw = F.transform("_n", lambda n: F.col("_total") / F.greatest(n, F.lit(1)))
    mean = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x) / classes
    out = counts.withColumn("_total", total).withColumn("_raw", raw).withColumn("_mean", F.greatest(mean, F.lit(1e-8)))
    each = out.select(*by, "_n", "_mean", F.posexplode("_raw").alias("class", "_x"))
    return each.select(*by, "class", F.col("_n")[F.col("class")].alias("n"), (F.col("_x") / F.col("_mean")).alias("weight"))


def trade_weight(rows: DataFrame, eps: float = 1e-8, bench: float = 1.0, by=SYM) -> DataFrame:
    """(trades, others, weight) of each group: bars without a trade for each trade, null if either is missing."""
    traded = F.abs(F.col("pos") - F.lag("pos", 1, bench).over(ordered(by))) > eps
    counts = rows.withColumn("_t", traded).groupBy(*by).agg(F.count_if("_t").alias("trades"), F.count_if(~F.col("_t")).alias("others"))
    return counts.withColumn("weight", F.when((F.col("trades") > 0) & (F.col("others") > 0), F.col("others") / F.col("trades")))


def chunk_actions(rows: DataFrame, k: int = 4, bench: float = 1.0, by=SYM) -> DataFrame:
    """(chunk, ts, current, action): each whole chunk of k bars by its first target that leaves the position before it.

    A chunk without such a target is stood for by its first; bars after the
    last whole chunk are left out.
    """
    numbered = rows.withColumn("_i", F.row_number().over(ordered(by)) - 1).withColumn("_before", F.lag("pos", 1, bench).over(ordered(by)))
    keyed = numbered.withColumn("chunk", F.floor(F.col("_i") / k))
    current = F.first("_before").over(Window.partitionBy(*by, "chunk").orderBy("_i"))
    marked = keyed.withColumn("_current", current).withColumn("_moved", F.abs(F.col("pos") - F.col("_current")) > 1e-8)
    found = marked.groupBy(*by, "chunk").agg(
        F.min("ts").alias("ts"), F.min_by("_current", "_i").alias("current"),
        F.coalesce(F.min_by("pos", F.when(F.col("_moved"), F.col("_i"))), F.min_by("pos", "_i")).alias("action"), F.count(F.lit(1)).alias("_n"),
    )
    return found.where(F.col("_n") == k).drop("_n")
